"""A registered source of rows by name, config and split: ``spark.read.format("corpus_rows")`` and ``readStream``.

A corpus is a folder, on any file system that pyarrow opens (local or shared folders, HDFS, object stores), that holds
``config/split/*.parquet`` or ``*.jsonl``. Options: ``path`` (or the argument of ``load``), ``config`` (default
``default``), ``split`` (default ``train``), ``splits`` (the allowed ones, by commas; default any that is there).
A config or split that is not there raises ValueError before any file is read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

NAME = "corpus_rows"


class Piece(InputPartition):
    """A JSON lines file, or one row group of a Parquet file."""

    def __init__(self, path: str, group: int | None = None):
        self.path, self.group = path, group


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Corpus:
    """Where the files of a split are."""

    def __init__(self, options: dict[str, str]):
        path, self.config, self.split = options.get("path"), options.get("config", "default"), options.get("split", "train")
        if not path:
            raise ValueError("give a path")
        allowed = [s.strip() for s in options.get("splits", "").split(",") if s.strip()]
        if allowed and self.split not in allowed:
            raise ValueError(f"no split {self.split!r}; there are {', '.join(allowed)}")
        self.files, root = _opened(path)
        self.root = root.rstrip("/")
        for folder, kind, name in ((self.root, "config", self.config), (f"{self.root}/{self.config}", "split", self.split)):
            there = self._folders(folder)
            if name not in there:
                raise ValueError(f"no {kind} {name!r}; there are {', '.join(there) or 'none'}")

    def _folders(self, folder: str) -> list[str]:
        from pyarrow import fs

        return sorted(i.base_name for i in self.files.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if i.type == fs.FileType.Directory)

    def listed(self) -> list[tuple[int, str]]:
        """(time of the last change in nanoseconds, path) of each file, in that order; hidden files do not count."""
        from pyarrow import fs

        found = self.files.get_file_info(fs.FileSelector(f"{self.root}/{self.config}/{self.split}"))
        return sorted((i.mtime_ns or 0, i.path) for i in found if i.is_file and i.base_name[0] not in "._" and i.extension in ("parquet", "jsonl"))

    def pieces(self, paths: list[str]) -> list[Piece]:
        import pyarrow.parquet as pq

        out = []
        for path in paths:
            groups = range(pq.ParquetFile(path, filesystem=self.files).num_row_groups) if path.endswith(".parquet") else [None]
            out += [Piece(path, g) for g in groups]
        return out

    def rows(self, piece: Piece, schema: StructType) -> Iterator:
        """Arrow batches in the columns of ``schema``; columns that a file lacks are null. A malformed line raises."""
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        want = to_arrow_schema(schema)
        if piece.group is None:
            with self.files.open_input_stream(piece.path) as stream:
                held: list[dict] = []
                for line in _lines(stream):
                    if line.strip():
                        held.append(json.loads(line))
                    if len(held) == 4096:
                        yield pa.RecordBatch.from_pylist(held, want)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, want)
            return
        file = pq.ParquetFile(piece.path, filesystem=self.files)
        for batch in file.iter_batches(4096, row_groups=[piece.group], columns=[n for n in want.names if n in file.schema_arrow.names]):
            columns = [batch.column(f.name).cast(f.type) if f.name in batch.schema.names else pa.nulls(batch.num_rows, f.type) for f in want]
            yield pa.RecordBatch.from_arrays(columns, schema=want)


def _lines(stream, size: int = 1 << 20) -> Iterator[bytes]:
    rest: list[bytes] = []
    while block := stream.read(size):
        first, *others = block.split(b"\n")
        rest.append(first)
        for other in others:
            yield b"".join(rest)
            rest = [other]
    yield b"".join(rest)


class _Batch(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.wanted = options, schema

    def partitions(self) -> list[Piece]:
        corpus = Corpus(self.options)
        return corpus.pieces([p for _, p in corpus.listed()])

    def read(self, partition: Piece) -> Iterator:
        yield from Corpus(self.options).rows(partition, self.wanted)


class _Stream(DataSourceStreamReader):
    """Offsets are (time, path) of the last file taken: files must arrive in that order, as those that are moved in do."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.wanted = options, schema

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        found = Corpus(self.options).listed()
        return {"time": found[-1][0], "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        corpus = Corpus(self.options)
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        return corpus.pieces([f[1] for f in corpus.listed() if low < f <= high])

    def read(self, partition: Piece) -> Iterator:
        yield from Corpus(self.options).rows(partition, self.wanted)


class CorpusRows(DataSource):
    """The schema is the first Parquet file's; JSON lines need one from the caller."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import from_arrow_schema

        corpus = Corpus(self.options)
        first = min((p for _, p in corpus.listed() if p.endswith(".parquet")), default=None)
        if first is None:
            raise ValueError("give a schema: the split has no Parquet file")
        return from_arrow_schema(pq.read_schema(first, filesystem=corpus.files))

    def reader(self, schema: StructType) -> DataSourceReader:
        Corpus(self.options)
        return _Batch(dict(self.options), schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        Corpus(self.options)
        return _Stream(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CorpusRows)
