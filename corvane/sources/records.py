"""Readers and writers of records: Parquet, JSON lines, CSV. All work on paths that only Spark can open."""

from __future__ import annotations

import csv
import io
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.sources.scratch import Scratch


def _files(spark: SparkSession, path: str) -> list[str] | None:
    """Names of the files in a folder and its subfolders, sorted; None for a file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise FileNotFoundError(path)
    if not fs.getFileStatus(p).isDirectory():
        return None
    root, found, listing = fs.makeQualified(p).toString().rstrip("/") + "/", [], fs.listFiles(p, True)
    while listing.hasNext():
        found.append(listing.next().getPath().toString()[len(root) :])
    return sorted(found)


def read_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None, *, strict: bool = True) -> DataFrame:
    """Parquet by suffix or folder, else JSON lines (blank lines are skipped, a malformed one raises).

    Subfolders, such as those of a resumable job, count as part of a folder. One without Parquet or JSON files raises FileNotFoundError if ``strict``, else gives no rows.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    names = _files(spark, path)
    if path.endswith(".parquet") or any(n.endswith(".parquet") for n in names or ()):
        nested = names is not None and not any(n.endswith(".parquet") and "/" not in n for n in names)
        return reader.option("recursiveFileLookup", nested).parquet(path)
    if any(n.endswith(".json") for n in names or ()):
        return reader.json(path, mode="FAILFAST")
    if names is not None:
        if strict:
            raise FileNotFoundError(f"no Parquet file in {path}")
        return spark.createDataFrame([], schema or T.StructType([]))
    return reader.json(path, mode="FAILFAST")


def read_ratings(spark: SparkSession, paths: list[str], axes: list[str]) -> DataFrame:
    """Ratings of several raters, one CSV file each: (axis, rater, sample_id, score), the last row of a sample with any
    valid score. The rater is the file's name without suffix; a byte order mark is ignored."""
    from corvane.operators.evaluate import valid_score

    if len(paths) < 2:
        raise ValueError("agreement needs two raters or more")
    out = None
    for p in paths:
        d = spark.read.option("header", True).option("multiLine", True).csv(p)
        d = d.toDF(*[c.lstrip("﻿") for c in d.columns])
        scores = [valid_score(F.col(a)).alias(a) if a in d.columns else F.lit(None).cast("int").alias(a) for a in axes]
        d = d.select("sample_id", *scores, F.monotonically_increasing_id().alias("line")).where(" OR ".join(f"{a} IS NOT NULL" for a in axes))
        last = d.groupBy("sample_id").agg(F.max_by(F.struct(*axes), "line").alias("s"))
        rater = p.rstrip("/").rpartition("/")[2].rpartition(".")[0]
        rows = last.select(F.lit(rater).alias("rater"), "sample_id", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col("s")[a].alias("score")) for a in axes])).alias("x"))
        rows = rows.select("x.axis", "rater", "sample_id", "x.score").where("score IS NOT NULL")
        out = rows if out is None else out.unionByName(rows)
    return out


def read_rows(spark: SparkSession, path: str | None = None, *, table: str | None = None, schema: T.StructType | str | None = None, split: str | None = None, splits: tuple[str, ...] = ("train",)) -> DataFrame:
    """Rows of a file or folder if one is given, else of a catalog table. A split that the source does not have raises
    ValueError, as does a call without a source."""
    if split is not None and split not in splits:
        raise ValueError(f"no split {split!r}; there are {', '.join(splits)}")
    if path is not None:
        return read_records(spark, path, schema)
    if table is None:
        raise ValueError("give a path or a table")
    return spark.read.table(table)


def parse_env(text: str) -> dict[str, str]:
    """KEY=VALUE lines: blank lines, comments and lines without a key are passed over, ``export`` before a key and a pair
    of quotes around a value are left out."""
    found = re.finditer(r"^[^\S\n]*(?!#)(?:export\s+)?([^=\s#][^=\n]*?)[^\S\n]*=[^\S\n]*(.*?)[^\S\n]*$", text, re.M)
    return {m[1]: m[2][1:-1] if len(m[2]) > 1 and m[2][0] == m[2][-1] and m[2][0] in "\"'" else m[2] for m in found}


def load_env(path: str, *, override: bool = False) -> int:
    """Sets the variables of a file on the driver that are not set, or all with ``override``; how many were set."""
    if not os.path.isfile(path):
        return 0
    with open(path, encoding="utf-8") as f:
        new = {k: v for k, v in parse_env(f.read()).items() if override or k not in os.environ}
    os.environ.update(new)
    return len(new)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_clean(df: DataFrame, path: str) -> bool:
    """Parquet, or JSON lines for a path that ends in .jsonl; no rows write nothing and return False."""
    df = Scratch(df.sparkSession, "clean").write(df, "rows")  # worked out once, for the look and for the copy
    if df.isEmpty():
        return False
    write_jsonl(df, path) if path.endswith(".jsonl") else df.write.mode("overwrite").parquet(path)
    return True


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_form(df: DataFrame, path: str) -> int:
    """A small form as one CSV file with a byte order mark, so that spreadsheets read it as UTF-8; the number of rows."""
    rows, out = df.collect(), io.StringIO()  # bounded by the form's size
    writer = csv.writer(out)
    writer.writerows([df.columns, *map(tuple, rows)])
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).create(p, True)
    stream.write(bytearray(b"\xef\xbb\xbf" + out.getvalue().encode()))
    stream.close()
    return len(rows)


def preview(before: DataFrame, after: DataFrame, key: str, fields: list[str], n: int = 5) -> str:
    """The first ``n`` records by key, each field before and after, as text."""
    both = before.select(key, *[F.col(f).alias(f"{f}_before") for f in fields]).orderBy(key).limit(n).join(after.select(key, *fields), key).orderBy(key).collect()
    return "\n\n".join("\n".join([f"{key}: {r[key]}", *[f"  {f}: {r[f + '_before']}\n  -> {r[f]}" for f in fields]]) for r in both)
