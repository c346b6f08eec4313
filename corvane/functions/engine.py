"""Settings of chess engines for a playing strength, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strengths, the one up to which a human-like engine plays, and the skill and depth of the other engine.
LEAST, CEILING, MOST = 800, 2200, 2600
SKILL, DEPTH, WEAK_SKILL, WEAK_DEPTH = (10, 20), (8, 18), (0, 10), (1, 7)


def _between(elo: Column, low: int, high: int, values: tuple[int, int]) -> Column:
    """Along the line from the value at ``low`` to that at ``high``, flat outside; rounded, halves to even."""
    share = (F.greatest(F.lit(low), F.least(F.lit(high), elo)) - low) / (high - low)
    return F.bround(values[0] + share * (values[1] - values[0])).cast("int")


def clamp_elo(elo: Column) -> Column:
    return F.greatest(F.lit(LEAST), F.least(F.lit(MOST), elo))


def route_engine(elo: Column) -> Column:
    return F.when(elo <= CEILING, "maia").otherwise("stockfish")


def skill_for_elo(elo: Column) -> Column:
    return _between(elo, CEILING, MOST, SKILL)


def depth_for_elo(elo: Column) -> Column:
    return _between(elo, CEILING, MOST, DEPTH)


def weak_settings(elo: Column) -> Column:
    """Skill and depth where the other engine stands in for the human-like one."""
    return F.struct(_between(elo, LEAST, CEILING, WEAK_SKILL).alias("skill"), _between(elo, LEAST, CEILING, WEAK_DEPTH).alias("depth"))
