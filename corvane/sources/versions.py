"""Small states that change by versions: of writers with the same base one wins, and readers see whole versions only."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

#: Versions that stay readable behind the newest.
KEEP = 8


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class Versions:
    """JSON values in a folder, one file for each version, committed by a rename that fails if the version exists.

    Works on file systems whose rename does so (HDFS, local folders). Versions are numbered from 1; the newest ``KEEP``
    and the one before them stay."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self.path().getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str = ""):
        return self.hadoop.Path(f"{self.folder}/{name}" if name else self.folder)

    def newest(self) -> int:
        """The newest version; 0 before the first commit."""
        if not self.fs.exists(self.path()):
            return 0
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path())]
        return max([int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")], default=0)

    def read(self, version: int, default=None):
        """The value of a version; ``default`` of version 0."""
        if version == 0:
            return default
        stream = self.fs.open(self.path(f"v{version:010d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, base: int, value) -> int:
        """Makes ``value`` version ``base`` + 1, or raises ``Conflict``."""
        aside, final = self.path(f".{uuid.uuid4().hex}"), self.path(f"v{base + 1:010d}.json")
        stream = self.fs.create(aside, False)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        if self.fs.exists(final) or not self.fs.rename(aside, final):
            self.fs.delete(aside, False)
            raise Conflict(f"version {base + 1} exists")
        self.fs.delete(self.path(f"v{base - KEEP:010d}.json"), False)
        return base + 1

    def update(self, change, default=None):
        """Commits ``change`` of the newest value, anew while others commit first; the value committed."""
        while True:
            base = self.newest()
            value = change(self.read(base, default))
            try:
                self.commit(base, value)
                return value
            except Conflict:
                continue
