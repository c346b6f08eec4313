"""Resumable jobs by rows: a ledger says how many rows are done and how many shards hold them.

Rows are numbered; a batch is a range of numbers. It is written as the shard of the next number, then the ledger commits
``{done, shards}``. A run that ends between the two leaves a shard that no ledger counts, and the next run writes the
same rows under the same number; so no row is lost or comes twice. Readers take the shards that the ledger counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.columns import free
from corvane.sources.scratch import Scratch
from corvane.sources.versions import Versions
from corvane.streaming.jobs import retrying


class Ledger:
    """The state of a job in its target folder."""

    def __init__(self, spark: SparkSession, target: str):
        self.spark, self.target = spark, target.rstrip("/")
        self.versions = Versions(spark, f"{self.target}/_ledger")

    def state(self) -> dict[str, int]:
        return self.versions.read(self.versions.newest(), {"done": 0, "shards": 0})

    def commit(self, done: int, shards: int) -> None:
        """Raises ``Conflict`` if another run commits meanwhile: two runs must not share a target."""
        self.versions.commit(self.versions.newest(), {"done": done, "shards": shards})

    def shard(self, number: int) -> str:
        return f"{self.target}/part-{number:05d}"

    def read(self) -> DataFrame | None:
        """All rows that are done; None before the first shard."""
        n = self.state()["shards"]
        return self.spark.read.parquet(*[self.shard(k) for k in range(n)]) if n else None


def run_by_rows(
    rows: DataFrame, transform: Callable[[DataFrame], DataFrame], target: str, *, ordinal: str = "ordinal", batch: int = 1_000_000, limit: int | None = None,
    resume: bool = False, dry_run: bool = False, samples: int = 20, tries: int = 3, show: Callable[[DataFrame, DataFrame], None] | None = None, sleep: Callable[[float], None] | None = None,
) -> int:
    """Runs ``transform`` over ``rows``, numbered from 0 by ``ordinal``, in batches of that many; the number of rows of this
    run.

    With ``resume`` the rows that the ledger counts are passed over, else the ledger starts anew; ``limit`` counts rows
    after those. A batch that fails is tried ``tries`` times. The rows to do are written once, by batch, so that no batch
    reads the whole input. ``dry_run`` writes and commits nothing: the first ``samples`` rows go to ``show``, before and after.
    """
    spark, ledger = rows.sparkSession, Ledger(rows.sparkSession, target)
    state = ledger.state() if resume else {"done": 0, "shards": 0}
    done, shards = state["done"], state["shards"]
    n = F.col(f"`{ordinal}`")
    rest = rows.where(n >= done)
    if limit is not None:
        rest = rest.where(n < done + limit)
    if dry_run:
        before = Scratch(spark, "dry-run").write(rest.where(n < done + samples), "rows")
        if show:
            show(before, transform(before))
        return before.count()
    (by,) = free(rows, "batch")
    path = Scratch(spark, "batches").path("rows")
    rest.withColumn(by, F.floor((n - done) / batch)).write.partitionBy(by).parquet(path)
    sizes = dict(spark.read.schema(T.StructType([*rows.schema.fields, T.StructField(by, T.LongType())])).parquet(path).groupBy(by).count().collect())  # a row for each batch
    if not resume:
        ledger.commit(0, 0)
    began = done
    for k in sorted(sizes):
        part = spark.read.schema(rows.schema).parquet(f"{path}/{by}={k}")
        write = lambda part=part: transform(part).write.mode("overwrite").parquet(ledger.shard(shards))  # noqa: E731, B023
        retrying(write, tries, **({"sleep": sleep} if sleep else {}))
        done, shards = done + sizes[k], shards + 1
        ledger.commit(done, shards)
    return done - began
