"""Names of columns that an operator adds for itself."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free(df: DataFrame | list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores behind it as it takes to be no column's name in any case."""
    taken = {c.lower() for c in (df if isinstance(df, list) else df.columns)}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
