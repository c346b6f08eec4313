"""A translation memory: what was translated once is not sent to a translator again, by any batch, run or writer.

Entries lie in segments (Parquet folders) that a versioned manifest names. A writer adds a segment and commits the manifest
anew if another was first, so none loses entries; a text that two writers translated keeps the entry of the earlier
segment. After ``SEGMENTS`` segments a writer merges them into one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources.versions import Versions

SEGMENTS = 32
SCHEMA = "key string, done string, fault string"


def key(text) -> F.Column:
    """What a text is known by."""
    return F.sha2(text, 256)


class TranslationMemory:
    """Translations by a hash of the source text, in ``folder``; a memory holds those of one translator."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.versions = Versions(spark, f"{self.folder}/manifest")

    def segments(self) -> list[str]:
        """Names of the newest version's segments, oldest first."""
        return self.versions.read(self.versions.newest(), [])

    def entries(self, segments: list[str] | None = None) -> DataFrame:
        """key, done, fault and age (0 for the oldest segment); a key may come once from each segment."""
        names = self.segments() if segments is None else segments
        if not names:
            return self.spark.createDataFrame([], SCHEMA + ", age int")
        rows = self.spark.read.schema(SCHEMA).parquet(*[f"{self.folder}/{n}" for n in names])
        name = F.element_at(F.split("_metadata.file_path", "/"), -2)
        ages = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])  # a few names
        return rows.select("key", "done", "fault", ages[name].alias("age"))

    def _oldest(self, entries: DataFrame) -> DataFrame:
        return entries.groupBy("key").agg(F.min_by(F.struct("done", "fault"), "age").alias("e")).select("key", "e.done", "e.fault")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """key, done and fault of those of ``keys`` (distinct) that are known."""
        return self._oldest(self.entries().join(keys.select("key"), "key", "left_semi"))

    def merge(self, entries: DataFrame) -> None:
        """Adds entries (key, done, fault). Those of keys that are known do no harm."""
        name = f"segment-{uuid.uuid4().hex}"
        entries.select("key", "done", "fault").write.parquet(f"{self.folder}/{name}")
        now = self.versions.update(lambda names: [*names, name], [])
        if len(now) >= SEGMENTS:
            self.compact(now)

    def compact(self, segments: list[str] | None = None) -> bool:
        """Merges segments into one; False, and nothing changed, if another writer merged one of them meanwhile. The
        old segments' files stay for those who read an older version, until ``vacuum``."""
        old = self.segments() if segments is None else segments
        name = f"segment-{uuid.uuid4().hex}"
        self._oldest(self.entries(old)).write.parquet(f"{self.folder}/{name}")

        def change(names: list[str]) -> list[str]:
            if not set(old) <= set(names):
                raise LookupError
            return [name, *[n for n in names if n not in old]]

        try:
            self.versions.update(change, [])
            return True
        except LookupError:
            self.versions.fs.delete(self.versions.hadoop.Path(f"{self.folder}/{name}"), True)
            return False

    def vacuum(self) -> list[str]:
        """Deletes segments that older versions name and the newest does not; call it while nobody reads or writes."""
        newest = self.versions.newest()
        named = {n for v in range(max(1, newest - 7), newest) for n in self.versions.read(v, [])}
        gone = sorted(named - set(self.segments()))
        for n in gone:
            self.versions.fs.delete(self.versions.hadoop.Path(f"{self.folder}/{n}"), True)
        return gone
