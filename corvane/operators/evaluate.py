"""Evaluation aggregates: accuracy by slice, claims, agreement of raters, nearest-rank quantiles, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.sources.scratch import Scratch

#: Distinct values of a range that one task ranks, about.
RANGE = 100_000


def accuracy(results: DataFrame, slices: list[str], correct: str = "correct", legal: str = "legal") -> DataFrame:
    """Overall and for each value of each slice: slice, value, n, hits, accuracy, legal_rate (4 digits)."""
    sets = [F.struct(F.lit("overall").alias("slice"), F.lit("all").alias("value")), *[F.struct(F.lit(s).alias("slice"), F.col(s).cast("string").alias("value")) for s in slices]]
    rows = results.select(F.explode(F.array(*sets)).alias("s"), F.col(correct).cast("int").alias("c"), F.col(legal).cast("int").alias("l"))
    out = rows.groupBy("s.slice", "s.value").agg(F.count("*").alias("n"), F.sum("c").alias("hits"), F.round(F.avg("c"), 4).alias("accuracy"), F.round(F.avg("l"), 4).alias("legal_rate"))
    return out


def claims_report(claims: DataFrame, answer: str = "answer_id", kind: str = "kind", is_true: str = "is_true") -> DataFrame:
    """By kind and in all: claims, false ones, their rate, answers, answers with a false claim."""
    each = claims.groupBy(kind, answer).agg(F.count("*").alias("n"), F.sum((~F.col(is_true)).cast("long")).alias("bad"))
    per = each.groupBy(F.col(kind).alias("kind"))
    total = each.groupBy(answer).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).groupBy(F.lit("all").alias("kind"))
    figures = [F.sum("n").alias("claims"), F.sum("bad").alias("false_claims"), (F.sum("bad") / F.sum("n")).alias("rate"), F.count("*").alias("answers"), F.sum((F.col("bad") > 0).cast("long")).alias("answers_with_error")]
    return per.agg(*figures).unionByName(total.agg(*figures))


def kappa(a: str, b: str) -> Column:
    """Quadratic-weighted kappa as an aggregate; the weights' scale cancels. 1 if the denominator is 0."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    below = F.sum(x * x) + F.sum(y * y) - 2 * F.sum(x) * F.sum(y) / F.count("*")
    return F.when(below == 0, 1.0).otherwise(1 - F.sum((x - y) * (x - y)) / below)


def valid_score(raw: Column, least: int = 1, most: int = 5) -> Column:
    """A rating cut to a whole number, null if it is no number or out of range."""
    n = raw.try_cast("double")
    whole = F.when(n.between(-(2.0**31), 2.0**31), n.cast("int"))
    return F.when(whole.between(least, most), whole)


def agreement(scores: DataFrame, raters: int) -> DataFrame:
    """From (axis, rater, sample_id, score): long rows axis, metric, who, value, n over the samples that all raters
    scored: ``mean`` by rater, ``kappa`` and ``within_one`` as means over the pairs of raters."""
    shared = scores.groupBy("axis", "sample_id").agg(F.countDistinct("rater").alias("k")).where(F.col("k") == raters).drop("k")
    common = scores.join(shared, ["axis", "sample_id"], "left_semi")
    means = common.groupBy("axis", F.col("rater").alias("who")).agg(F.avg("score").alias("value"), F.count("*").alias("n")).withColumn("metric", F.lit("mean"))
    other = common.select("axis", "sample_id", F.col("rater").alias("rater2"), F.col("score").alias("score2"))
    pairs = common.join(other, ["axis", "sample_id"]).where(F.col("rater") < F.col("rater2"))
    near = F.avg((F.abs(F.col("score") - F.col("score2")) <= 1).cast("double"))
    by_pair = pairs.groupBy("axis", "rater", "rater2").agg(kappa("score", "score2").alias("kappa"), near.alias("within_one"), F.count("*").alias("n"))
    both = by_pair.groupBy("axis").agg(F.avg("kappa").alias("kappa"), F.avg("within_one").alias("within_one"), F.max("n").alias("n"))
    long = both.select("axis", "n", F.expr("stack(2, 'kappa', kappa, 'within_one', within_one) AS (metric, value)")).withColumn("who", F.lit("all"))
    return means.select("axis", "metric", "who", "value", "n").unionByName(long.select("axis", "metric", "who", "value", "n"))


def nearest_rank(df: DataFrame, column: str, shares: tuple[float, ...] = (0.5, 0.9, 0.99), *, ranges: int | None = None) -> DataFrame:
    """q and the value of rank min(n - 1, floor(q * n)) from 0 in ascending order; q 1.0 is the greatest. Nulls do not
    count; without values there are no rows.

    Values are counted and cut into ranges of about equal numbers of distinct ones (one for each ``RANGE`` of them); the
    ranges' totals tell which hold the ranks, and only those are ranked. Up to ``RANGE`` distinct values are one range.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "ranks")
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("k"))
    counts = scratch.write(counts, "values")
    if ranges is None:
        ranges = 1 + counts.count() // RANGE
    if ranges > 1:
        counts = scratch.write(counts.repartitionByRange(ranges, "v").withColumn("p", F.spark_partition_id()), "counts")
    else:
        counts = counts.withColumn("p", F.lit(0))
    totals = counts.groupBy("p").agg(F.sum("k").alias("k")).orderBy("p").collect()  # a row for each range
    n, before, wanted = sum(t["k"] for t in totals), 0, []
    ranks = [(float(q), min(n - 1, int(q * n))) for q in (*shares, 1.0)] if n else []
    for t in totals:
        wanted += [(q, t["p"], rank - before) for q, rank in ranks if before <= rank < before + t["k"]]
        before += t["k"]
    upto = F.sum("k").over(Window.partitionBy("p").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    asked = F.broadcast(spark.createDataFrame(wanted, "q double, p int, rank long"))  # a row for each share
    found = counts.where(F.col("p").isin([p for _, p, _ in wanted])).withColumn("upto", upto).join(asked, "p")
    return found.where(F.col("upto") > F.col("rank")).groupBy("q").agg(F.min("v").alias("value"))


def reason_report(df: DataFrame, reasons: str) -> DataFrame:
    """From an array of reject labels by row: reason, n, pct of all rows; with rows ``total``, ``passed``, ``rejected``."""
    rows = df.select(F.explode(F.concat(F.array(F.lit("total")), F.when(F.size(reasons) == 0, F.array(F.lit("passed"))).otherwise(F.array(F.lit("rejected"))), F.array_distinct(reasons))).alias("reason"))
    n = rows.groupBy("reason").agg(F.count("*").alias("n"))
    total = F.max(F.when(F.col("reason") == "total", F.col("n"))).over(Window.partitionBy())
    return n.withColumn("pct", 100.0 * F.col("n") / total)


def alarm(rejected: int, total: int, limit: float = 0.25) -> bool:
    return total > 0 and rejected / total > limit
