"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable shards (Parquet files). A shard's tier is the power of ``FAN_IN`` that its
size reaches, counted down from the target size. When a tier holds a run of ``FAN_IN`` shards or more, they are merged
into files of about the target size, or one of a higher tier. Each append and merge writes its files first and then
commits a manifest: the next version number, written aside and renamed, which fails if another writer took it; the
loser tries again on the newer version. Readers read one version, which stays whole until ``vacuum`` retires it.

A commit is atomic where a rename to a new name is, and fails if the name exists: on HDFS and local folders. Object
stores that copy on rename need a folder with that property for ``manifest``.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm._common import Scratch, few, table

TARGET_BYTES, FAN_IN, ARRIVALS = 64 << 20, 4, 3
#: Files and groups that one job of a compaction merges at most; what is left is merged by the next job.
MERGE_FILES, MERGE_GROUPS = 20_000, 200
#: Unless off, a union of inputs of one partition each has one partition, from Spark 4.1 on.
UNION_CONF = "spark.sql.unionOutputPartitioning"
#: Versions that ``vacuum`` keeps, and seconds for which it keeps older ones.
KEEP_VERSIONS, KEEP_SECONDS = 2, 7 * 24 * 3600.0


def _short(path: str) -> str:
    """A file's name with its folder's: one task's files in several folders have equal names."""
    return "/".join(path.split("/")[-2:])


def _name() -> Column:
    return F.substring_index(F.col("_metadata.file_path"), "/", -2)


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class ShardStore:
    """A folder of shards under versioned manifests.

    A manifest has a row for each file, none for documents; the driver reads it whole, as it does the list of files of
    any table."""

    def __init__(self, spark: SparkSession, folder: str, schema, *, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self.target, self.fan_in = target_bytes, fan_in
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.hadoop.Path(f"{self.folder}/{name}" if name else self.folder)

    # manifests

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        if not self.fs.exists(self._path("manifest")):
            return 0
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path("manifest"))]
        return max([int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")], default=0)

    def manifest(self, version: int | None = None) -> list[dict]:
        version = self.version() if version is None else version
        if version == 0:
            return []
        stream = self.fs.open(self._path(f"manifest/v{version:08d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, base: int, shards: list[dict]) -> int:
        """Makes ``shards`` version ``base`` + 1, or raises ``Conflict``: of writers with the same base one wins."""
        aside, final = self._path(f"manifest/.{uuid.uuid4().hex}"), self._path(f"manifest/v{base + 1:08d}.json")
        stream = self.fs.create(aside, False)
        stream.write(bytearray(json.dumps(shards).encode()))
        stream.close()
        if self.fs.exists(final) or not self.fs.rename(aside, final):
            self.fs.delete(aside, False)
            raise Conflict(f"version {base + 1} exists")
        return base + 1

    # shards

    def _written(self, folder: str, first: int, generation: int) -> list[dict]:
        """Entries of the files under a folder, in order of their names; rows are counted from the files' footers."""
        found, listing = [], self.fs.listFiles(self._path(folder), True)
        while listing.hasNext():
            s = listing.next()
            if s.getPath().getName().endswith(".parquet"):
                found.append((s.getPath().toString(), s.getLen()))
        files = self.spark.read.schema(self.schema).parquet(f"{self.folder}/{folder}")
        rows = {r["name"]: r["n"] for r in files.groupBy(_name().alias("name")).agg(F.count("*").alias("n")).collect()}  # a row for each file
        found = [(p, size, rows.get(_short(p), 0)) for p, size in sorted(found)]
        return [{"shard": first + i, "path": p[len(self._root()) :], "bytes": size, "rows": n, "generation": generation} for i, (p, size, n) in enumerate(x for x in found if x[2])]

    def _root(self) -> str:
        return self.fs.makeQualified(self._path("")).toString() + "/"

    def next_shard(self, shards: list[dict]) -> int:
        return 1 + max([s["shard"] for s in shards], default=-1)

    def append(self, docs: DataFrame) -> int:
        """Writes an arrival as small shards and commits them; an empty arrival commits nothing new."""
        folder = f"data/a-{uuid.uuid4().hex}"
        docs.write.parquet(f"{self.folder}/{folder}")
        new = self._written(folder, 0, 0)
        return self._replace([], new) if new else self.version()

    def _replace(self, gone: list[dict], new: list[dict]) -> int:
        """Commits the newest version without ``gone`` and with ``new``, numbered on; anew while others commit first.
        Raises ``Conflict`` if a shard of ``gone`` is no longer there."""
        while True:
            shards = self.manifest(base := self.version())
            paths = {s["path"] for s in gone}
            kept, first = [s for s in shards if s["path"] not in paths], self.next_shard(shards)
            if len(kept) != len(shards) - len(paths):
                raise Conflict("another writer merged these shards")
            try:
                return self.commit(base, kept + [s | {"shard": first + i} for i, s in enumerate(new)])
            except Conflict:
                continue

    def tier(self, size: int) -> int:
        """0 from the target size on, else how often it must grow by ``fan_in`` to reach it."""
        tier = 0
        while size < self.target and tier < 60:
            size, tier = max(1, size) * self.fan_in, tier + 1
        return tier

    def plan(self, shards: list[dict]) -> list[list[dict]]:
        """Groups to merge: runs of at least ``fan_in`` shards of one tier, each group closed at the target size; the
        shards left over when a group closes wait with their tier unless they are a run themselves."""
        tiers: dict[int, list[dict]] = {}
        for s in sorted(shards, key=lambda s: s["shard"]):
            if t := self.tier(s["bytes"]):
                tiers.setdefault(t, []).append(s)
        groups = []
        for _, run in sorted(tiers.items()):
            if len(run) < self.fan_in:
                continue
            group: list[dict] = []
            for s in run:
                group.append(s)
                if sum(x["bytes"] for x in group) >= self.target:
                    groups.append(group)
                    group = []
            if len(group) >= self.fan_in:
                groups.append(group)
        return [g for g in groups if len(g) > 1]

    def compact(self) -> int:
        """Merges by ``plan`` until no tier has a run; every merge is one job and one commit.

        Each group is smaller than two target sizes and has a task of its own, which reads the group's files and writes
        one; no row is shuffled. So each merge leaves fewer shards. Older versions stay readable, with their files, until
        ``vacuum``."""
        while groups := self.plan(self.manifest(self.version())):
            job: list[list[dict]] = []
            for g in groups:
                if job and (len(job) == MERGE_GROUPS or sum(map(len, job)) + len(g) > MERGE_FILES):
                    break
                job.append(g)
            merged = [s for g in job for s in g]
            folder = f"data/m-{uuid.uuid4().hex}"
            with self._partitions_kept():
                reduce(DataFrame.union, [self._files(g).coalesce(1) for g in job]).write.parquet(f"{self.folder}/{folder}")
            new = self._written(folder, 0, 1 + max(s["generation"] for s in merged))
            if sum(s["rows"] for s in new) != sum(s["rows"] for s in merged):
                raise RuntimeError("a merge lost or gained rows; nothing was committed")
            try:
                self._replace(merged, new)
            except Conflict:  # another compaction was first; its result is planned anew, and no manifest names these files
                self.fs.delete(self._path(folder), True)
                continue
        return self.version()

    @contextmanager
    def _partitions_kept(self) -> Iterator[None]:
        """Meanwhile a union has the partitions of all its inputs."""
        before = self.spark.conf.get(UNION_CONF, None)
        self.spark.conf.set(UNION_CONF, "false")
        try:
            yield
        finally:
            self.spark.conf.set(UNION_CONF, before) if before else self.spark.conf.unset(UNION_CONF)

    def _files(self, shards: list[dict]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[self.folder + "/" + s["path"] for s in shards])

    def _rows(self, shards: list[dict]) -> DataFrame:
        """All rows of shards, with columns c0, c1, … and ``file``, the short name of theirs."""
        return self._files(shards).select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(self.schema.fields)], _name().alias("file"))

    def _named(self) -> list[Column]:
        return [F.col(f"c{i}").alias(f.name) for i, f in enumerate(self.schema.fields)]

    def vacuum(self, versions: int = KEEP_VERSIONS, seconds: float = KEEP_SECONDS) -> list[int]:
        """Retires versions: all but the newest ``versions`` that were committed more than ``seconds`` ago. Their
        manifests go, then the files that only they name; the retired versions are returned.

        Files that no manifest has named yet, such as those of a writer before its commit, are never touched."""
        newest, old = self.version(), []
        for v in range(newest - max(1, versions), 0, -1):
            path = self._path(f"manifest/v{v:08d}.json")
            if not self.fs.exists(path):
                break
            if time.time() - self.fs.getFileStatus(path).getModificationTime() / 1000 >= seconds:
                old.append(v)
        named = {s["path"] for v in old for s in self.manifest(v)}
        live = {s["path"] for v in range(newest, 0, -1) if v not in old and self.fs.exists(self._path(f"manifest/v{v:08d}.json")) for s in self.manifest(v)}
        for v in sorted(old):
            self.fs.delete(self._path(f"manifest/v{v:08d}.json"), False)
        for path in sorted(named - live):
            self.fs.delete(self._path(path), False)
        return sorted(old)

    def read(self, version: int | None = None, shard: str | None = None) -> DataFrame:
        """All rows of a version with the number of their shard in ``shard``, or else in the first of shard, shard_,
        shard__, … that no column of the rows has as its name."""
        shards = self.manifest(version)
        taken = {f.name.lower() for f in self.schema.fields}
        shard = shard or next(n for n in ("shard" + "_" * i for i in range(len(taken) + 1)) if n not in taken)
        if not shards:
            return self.spark.createDataFrame([], self.schema).withColumn(shard, F.lit(None).cast("long"))
        names = self.spark.createDataFrame([(_short(s["path"]), s["shard"]) for s in shards], "file string, number long")
        return self._rows(shards).join(few(shards, names), "file").select(*self._named(), F.col("number").alias(shard))


def shard_documents(docs: DataFrame, folder: str, *, id_col: str = "doc_id", arrivals: int = ARRIVALS, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN) -> ShardStore:
    """Appends ``docs`` in arrivals (by a hash of the id; nulls in the first) and compacts after each.

    All rows are kept, repeated ones, nulls and very long texts too, with all columns whatever their names; an empty
    table gives an empty store.
    """
    store = ShardStore(docs.sparkSession, folder, docs.schema, target_bytes=target_bytes, fan_in=fan_in)
    turn = F.coalesce(F.pmod(F.xxhash64(id_col), F.lit(arrivals)), F.lit(0))
    for k in range(arrivals):
        store.append(docs.where(turn == k))
        store.compact()
    return store


def op5_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars and the shard of each document, read back from the newest version, with the shard's figures."""
    store = shard_documents(table(spark, sf_dir, "documents"), Scratch(spark, "shards").path("store"))
    rows = [(s["shard"], s["rows"], s["bytes"], s["generation"]) for s in store.manifest()]
    figures = spark.createDataFrame(rows, "shard long, shard_rows long, shard_bytes long, generation long")
    return store.read().select("doc_id", "n_chars", "shard").join(few(rows, figures), "shard")
