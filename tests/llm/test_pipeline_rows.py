import os
import subprocess
import sys

from conftest import ROOT, SF
from test_llm import ROWS, SCHEMA

import corpus_pipeline
from corvane.llm import sharding


def tables(spark, folder, documents):
    documents.write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_odd_clashing_and_repeated_rows_and_a_store_of_the_callers(spark, tmp_path):
    rows = [(*r, "s", 1, "k", "d", 2, "z", 3, 7, "S", 1, "c") for r in [*ROWS, ROWS[4], (9, None, None, None), (10, " ".join(f"w{i}" for i in range(200_000)), "en", "a")]]
    extra = ", shard int, `shard_` string, `__size` int, copies string"
    frame = spark.createDataFrame(rows, SCHEMA + extra)
    got = corpus_pipeline.run(spark, tables(spark, tmp_path / "in", frame), store=str(tmp_path / "store"))
    assert got.columns == [*frame.columns, "shard__"]
    out = got.collect()
    given = {tuple(r) for r in rows}
    assert {tuple(r)[:-1] for r in out} <= given
    kept = sharding.ShardStore(spark, str(tmp_path / "store"), frame.schema).read()
    assert sorted(map(str, kept.collect())) == sorted(map(str, out))


def test_an_empty_table(spark, tmp_path):
    frame = spark.createDataFrame([], SCHEMA + ", shard int")
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, frame)).count() == 0


def test_the_entry_without_a_library_or_the_folder():
    blocked = "import sys; sys.modules[{!r}] = None; import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"
    for name in ("xxhash", "tokenizers", "corvane.llm", "corpus_pipeline"):
        said = subprocess.run([sys.executable, "-W", "ignore", "-c", blocked.format(name)], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True)
        n, has = said.stdout.split()
        assert int(n) >= 29 and (has == "False" or name == "tokenizers"), (name, said.stderr)
