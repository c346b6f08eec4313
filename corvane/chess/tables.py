"""Table functions over texts and positions, for lateral joins: a row for each token or claim, as it is found.

``register`` names them for SQL: ``FROM texts, LATERAL notation_tokens(text, fen, true)``. The columns of a frame are given
by ``token_rows`` and ``move_claim_rows``; no text's tokens are gathered in an array.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.chess import notation
from corvane.chess.position import position
from corvane.chess.udf import each_move_claim
from corvane.functions.columns import free


@F.udtf(returnType="start int, end int, text string, kind string", useArrow=True)
class NotationTokens:
    """Tokens of a text within a position's variations; without a position, or with what is none, by the text alone, where
    bare pawn moves need something sure beside them unless ``need_context`` is false. A null text has none. With ``keep``
    a text without tokens has a row of nulls, as Spark leaves such rows out of a left join with a Python table function."""

    def eval(self, text: str, fen: str, need_context: bool, keep: bool = False) -> Iterator[tuple]:
        found = None
        if text is not None:
            for found in notation.each(text, fen if fen and position(fen) else None, need_context=need_context is not False):
                yield found
        if keep and found is None:
            yield None, None, None, None


@F.udtf(returnType="text string, is_true boolean", useArrow=True)
class MoveClaims:
    """Moves that a text tells of a position, and whether some variation accepts them; none without text or position."""

    def eval(self, text: str, fen: str) -> Iterator[tuple]:
        for claim in each_move_claim(text, fen):
            yield claim["text"], claim["is_true"]


def register(spark: SparkSession) -> None:
    """``notation_tokens(text, fen, need_context)`` and ``move_claims(text, fen)`` in SQL."""
    spark.udtf.register("notation_tokens", NotationTokens)
    spark.udtf.register("move_claims", MoveClaims)


def _joined(df: DataFrame, given: dict[str, Column], table, outs: list[str]) -> tuple[DataFrame, list[str]]:
    """``df`` beside the rows of ``table`` of columns that are worked out first, as a lateral join takes names only; and
    free names for ``outs``, the columns of ``table``."""
    names = free(df, *given, *outs)
    names, outs = names[: len(given)], names[len(given) :]
    rows = df.select("*", *[c.alias(n) for n, c in zip(names, given.values())])
    return rows.lateralJoin(table(*[F.col(n).outer() for n in names]).toDF(*outs)), outs


def token_rows(df: DataFrame, text: Column, fen: Column | None = None, need_context: Column | None = None, *, into: str = "token", outer: bool = False) -> DataFrame:
    """A row for each token: the columns of ``df`` and ``into``, a struct of start, end, text and kind. With ``outer`` a row
    without tokens stays, with null; else it goes."""
    given = {"given": text, "fen": F.lit(None).cast("string") if fen is None else fen, "need": F.lit(True) if need_context is None else need_context, "keep": F.lit(outer)}
    fields = ["start", "end", "text", "kind"]
    rows, outs = _joined(df, given, NotationTokens, fields)
    token = F.struct(*[F.col(c).alias(f) for c, f in zip(outs, fields)])
    return rows.select(*[F.col(f"`{c}`") for c in df.columns if c != into], F.when(F.col(outs[0]).isNotNull(), token).alias(into))


def move_claim_rows(df: DataFrame, text: Column, fen: Column, *, into: str = "claim") -> DataFrame:
    """A row for each move that a text tells: the columns of ``df`` and ``into``, a struct of text and is_true."""
    rows, outs = _joined(df, {"given": text, "fen": fen}, MoveClaims, ["text", "is_true"])
    claim = F.struct(*[F.col(c).alias(f) for c, f in zip(outs, ["text", "is_true"])])
    return rows.select(*[F.col(f"`{c}`") for c in df.columns if c != into], claim.alias(into))
