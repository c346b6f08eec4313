"""Stratified sampling: rating buckets, round robin over cells, disjoint test and train, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.columns import free
from corvane.sources.scratch import Scratch

#: Seed, width of a rating bucket, and names of what has no theme or bucket.
SEED, WIDTH, UNTAGGED, NO_BUCKET = 20240911, 400, "untagged", "?"
#: Rows of a round of greedy assignment, and rows from the driver that are broadcast at most.
HEAD, FEW = 100_000, 100_000


def rating_bucket(rating: Column, width: int = WIDTH) -> Column:
    """``low-high`` of the bucket that holds the rating; raises for a width below 1."""
    if width <= 0:
        raise ValueError("width must be positive")
    low = (F.floor(rating / width) * width).cast("long")
    return F.concat(low.cast("string"), F.lit("-"), (low + width - 1).cast("string"))


def _order(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def round_robin(df: DataFrame, cells: list[str], key: str, size: int | None = None, *, seed: int = SEED) -> DataFrame:
    """One row of each cell a pass, cells in order, rows of a cell by a seeded hash of ``key``; the first ``size``.

    Adds ``rn``, the pass. With a size no cell gives more rows than it, so each task first cuts its part of a cell to
    that many; then the cut is a top-k.
    """
    w = Window.partitionBy(*cells).orderBy(_order(F.col(key), seed), key)
    out = df.withColumn("rn", F.row_number().over(w))
    return out if size is None else out.where(F.col("rn") <= size).orderBy("rn", *cells).limit(size)


def test_then_train(df: DataFrame, cells: list[str], key: str, test: int, train: int, *, seed: int = SEED) -> DataFrame:
    """Round robin for the test rows first, then anew over what is left for the train rows; ``split`` names which.
    The test rows are written once, as both parts need them."""
    first = round_robin(df, cells, key, test, seed=seed).drop("rn").withColumn("split", F.lit("test"))
    first = Scratch(df.sparkSession, "split").write(first, "test")
    rest = df.join(first.select(key), key, "left_anti")
    return first.unionByName(round_robin(rest, cells, key, train, seed=seed).drop("rn").withColumn("split", F.lit("train")))


def balanced_order(df: DataFrame, key: str, size: int | None = None, *, theme: str = "primary_theme", bucket: str = "rating_bucket", seed: int = SEED) -> DataFrame:
    """``round_robin`` over themes and buckets; rows without one are in the cells ``untagged`` and ``?``."""
    filled = lambda c, none: F.coalesce(F.when(F.col(c) != "", F.col(c).cast("string")), F.lit(none))
    t, b = free(df, "theme", "bucket")
    cells = df.withColumns({t: filled(theme, UNTAGGED), b: filled(bucket, NO_BUCKET)})
    return round_robin(cells, [t, b], key, size, seed=seed).drop(t, b)


def leaks(a: DataFrame, b: DataFrame, key: str) -> int:
    """Rows of ``a`` whose key is also in ``b``: must be 0."""
    return a.join(b.select(key), key, "left_semi").count()


def distribution(df: DataFrame, by: str) -> DataFrame:
    """Rows and share of each value."""
    n = df.groupBy(by).agg(F.count("*").alias("n"))
    return n.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


class Cells:
    """Greedy assignment of rows to cells: the state between rounds, which grows with the cells, not with the rows."""

    def __init__(self, cap: int):
        self.cap = cap
        self.count: dict[tuple, int] = {}
        self.themes: dict[object, set[str]] = {}
        self.taken: dict[object, tuple] = {}

    def take(self, key, bucket, themes: list[str], order) -> None:
        """The row's theme with the fewest rows so far in its bucket, ties by name, gets it if it has room and the key is new."""
        theme = min(themes, key=lambda t: (self.count.get((bucket, t), 0), t))
        if key not in self.taken and self.count.get((bucket, theme), 0) < self.cap:
            self.count[bucket, theme] = self.count.get((bucket, theme), 0) + 1
            self.taken[key] = (theme, order)

    def full(self) -> dict:
        """The full themes of each bucket that has one."""
        out: dict = {}
        for (bucket, theme), n in self.count.items():
            if n >= self.cap:
                out.setdefault(bucket, []).append(theme)
        return out


def _small(spark, rows: list, schema: str) -> DataFrame:
    """A frame of rows that came from the driver, broadcast up to a number of them."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= FEW else df


def least_filled(df: DataFrame, bucket: str, themes: str, key: str, order: str, cap: int, *, head: int = HEAD) -> DataFrame:
    """Greedy assignment in ``order`` (unique): each row goes to its theme with the fewest rows so far in its bucket (ties
    by name, ``untagged`` without themes), unless that cell has ``cap`` rows or the key was accepted before, in whatever
    bucket. Null themes do not count; null keys are one key.

    Adds ``primary_theme`` and ``status`` (accepted, duplicate, cell_full). Rounds: the first ``head`` rows in order that
    may still be accepted are assigned one after another; then cells that are full and keys that are taken go back as
    small tables, and rows of which all cells are full, or the key is taken, are no candidates any more. So at most the
    accepted rows, ``cap`` for each cell, and a head of others pass through the driver, as ids and themes; no task holds
    a bucket, and all other rows are settled in columns at the end.
    """
    spark = df.sparkSession
    kind = dict(df.dtypes)
    b, k, t, o = "bucket", "key", "themes", "at"
    own = F.filter(F.coalesce(F.col(f"`{themes}`"), F.array().cast("array<string>")), lambda x: x.isNotNull())
    slim = df.select(F.col(f"`{bucket}`").alias(b), F.col(f"`{key}`").alias(k), F.when(F.size(own) > 0, own).otherwise(F.array(F.lit(UNTAGGED))).alias(t), F.col(f"`{order}`").alias(o))
    slim = Scratch(spark, "cells").write(slim, "rows")
    cells, last = Cells(cap), None
    taken_schema, full_schema = f"k {kind[key]}, theme string, since {kind[order]}", f"b {kind[bucket]}, full array<string>"
    taken = lambda: _small(spark, [(key, *v) for key, v in cells.taken.items()], taken_schema)
    while True:
        left = slim if last is None else slim.where(F.col(o) > F.lit(last))
        if full := cells.full():
            left = left.join(_small(spark, list(full.items()), full_schema), F.col(b).eqNullSafe(F.col("b")), "left")
            left = left.where(F.col("full").isNull() | (F.size(F.array_except(t, "full")) > 0)).select(b, k, t, o)
        if cells.taken:
            left = left.join(taken(), F.col(k).eqNullSafe(F.col("k")), "left_anti")
        rows = left.orderBy(o).limit(head).collect()
        for r in rows:
            cells.take(r[k], r[b], r[t], r[o])
        if len(rows) < head:
            break
        last = rows[-1][o]
    out = slim.join(taken(), F.col(k).eqNullSafe(F.col("k")), "left")
    accepted = F.coalesce(F.col(o) == F.col("since"), F.lit(False))
    status = F.when(accepted, "accepted").when(F.col(o) > F.col("since"), "duplicate").otherwise("cell_full")
    return out.select(F.col(b).alias(bucket), F.col(k).alias(key), F.col(o).alias(order), F.when(accepted, F.col("theme")).alias("primary_theme"), status.alias("status"))


def balanced_sample(puzzles: DataFrame, order: str, train: int, test: int, *, per_cell: int | None = None, max_scan: int | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """From prepared puzzles (puzzle_id, rating_bucket, themes, error, …): the sample with its ``primary_theme`` and
    ``split``, and a tally (reason, n) of the rows that were passed over.

    The first ``max_scan`` rows in ``order`` are looked at. Those with an error count under it; the others are assigned
    to cells of at most ``per_cell`` rows (a hundredth of the sample, at least one), each id once, whatever its buckets,
    then split: test first.
    """
    if max_scan is not None:
        puzzles = puzzles.orderBy(order).limit(max_scan)
    scratch = Scratch(puzzles.sparkSession, "balanced")
    rows = scratch.write(puzzles.drop("primary_theme"), "rows")
    cap = max(1, (train + test) // 100) if per_cell is None else per_cell
    filled = scratch.write(least_filled(rows.where("error IS NULL"), "rating_bucket", "themes", "puzzle_id", order, cap).select(order, "primary_theme", "status"), "filled")
    sample = rows.join(filled.where("status = 'accepted'").drop("status"), order)
    failed = rows.where("error IS NOT NULL").select(F.col("error").alias("reason"))
    tally = failed.unionByName(filled.where("status <> 'accepted'").select(F.col("status").alias("reason"))).groupBy("reason").agg(F.count("*").alias("n"))
    return test_then_train(sample, ["primary_theme", "rating_bucket"], "puzzle_id", test, train, seed=seed), tally


def rating_form(rows: DataFrame, key: str, size: int = 100, *, answer: str = "answer", question: str = "question", seed: int = SEED) -> DataFrame:
    """Rows for raters to fill in: sample_id, fen, question, answer and three empty columns. Of the rows with an answer
    all, or ``size`` by a seeded hash of ``key``. ``sample_id`` is puzzle_id, else id, else the row's number; 0 and empty
    ids count as none. Raises ValueError if no row has an answer."""
    pool = rows.where(F.col(answer).isNotNull())
    (h,) = free(rows, "h")
    chosen = pool.withColumn(h, _order(F.col(key), seed)).orderBy(h, key).limit(size)
    given = [F.when(~F.col(c).cast("string").isin("", "0"), F.col(c).cast("string")) for c in ("puzzle_id", "id") if c in rows.columns]
    number = (F.row_number().over(Window.orderBy(h, key)) - 1).cast("string")  # at most ``size`` rows
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")
    out = chosen.select(F.coalesce(*given, number).alias("sample_id"), text("fen").alias("fen"), text(question).alias("question"), F.col(answer).alias("answer"), *[F.lit("").alias(c) for c in ("naturalness", "terminology", "notes")])
    if pool.isEmpty():
        raise ValueError("no row has an answer to rate")
    return out
