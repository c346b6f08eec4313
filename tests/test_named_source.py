import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from corvane.sources import named


@pytest.fixture(scope="module", autouse=True)
def source(spark):
    named.register(spark)


def put(folder, name, rows):
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / name
    if name.endswith(".parquet"):
        pq.write_table(pa.Table.from_pylist(rows, pa.schema([("id", pa.int64()), ("text", pa.string())])), path, row_group_size=3)
    else:
        path.write_text("\n\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\n")
    return path


def test_splits_are_read_by_row_group(spark, tmp_path):
    put(tmp_path / "sft" / "train", "a.parquet", [{"id": i, "text": None if i == 4 else f"é{i}"} for i in range(8)])
    put(tmp_path / "sft" / "train", "b.jsonl", [{"id": 100, "text": "x\ny"}, {"id": 101, "other": 1}])
    put(tmp_path / "sft" / "train", "_part.parquet", [{"id": 999, "text": "hidden"}])
    put(tmp_path / "rl" / "test", "a.parquet", [{"id": 7, "text": "rl"}])
    df = spark.read.format("corpus_rows").option("config", "sft").load(str(tmp_path))
    assert df.schema.simpleString() == "struct<id:bigint,text:string>" and df.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, df.collect())) == [*((i, None if i == 4 else f"é{i}") for i in range(8)), (100, "x\ny"), (101, None)]
    more = spark.read.format("corpus_rows").schema("text string, missing int").option("config", "sft").load(f"file://{tmp_path}")
    assert more.where("missing IS NULL").count() == 10
    assert [tuple(r) for r in spark.read.format("corpus_rows").option("config", "rl").option("split", "test").load(str(tmp_path)).collect()] == [(7, "rl")]


def test_what_is_not_there_raises_before_reading(spark, tmp_path):
    put(tmp_path / "sft" / "train", "a.jsonl", [{"id": 1}])
    read = lambda **options: spark.read.format("corpus_rows").schema("id long").options(**options).load(str(tmp_path)).collect()
    for options, said in (({"config": "none"}, "no config 'none'; there are sft"), ({"config": "sft", "split": "test"}, "no split 'test'; there are train"), ({"config": "sft", "split": "rl", "splits": "sft, train"}, "there are sft, train")):
        with pytest.raises(Exception, match=said):
            read(**options)
    with pytest.raises(Exception, match="give a schema"):
        spark.read.format("corpus_rows").option("config", "sft").load(str(tmp_path)).collect()
    put(tmp_path / "sft" / "train", "b.jsonl", []).write_text("{broken\n")
    with pytest.raises(Exception, match="Expecting"):
        read(config="sft")


def test_streams_take_each_file_once(spark, tmp_path):
    folder = tmp_path / "in" / "default" / "train"

    def run():
        rows = spark.readStream.format("corpus_rows").schema("id long, text string").load(str(tmp_path / "in"))
        rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="0 seconds").start()
        for q in spark.streams.active:
            q.processAllAvailable()
            q.stop()
        return sorted(r.id for r in spark.read.schema("id long, text string").parquet(str(tmp_path / "out")).collect())

    os.utime(put(folder, "b.parquet", [{"id": i, "text": "t"} for i in range(5)]), ns=(1, 10**9))
    assert run() == [0, 1, 2, 3, 4]
    os.utime(put(folder, "a.jsonl", [{"id": 5}]), ns=(1, 2 * 10**9))
    assert run() == [0, 1, 2, 3, 4, 5]
    assert run() == [0, 1, 2, 3, 4, 5]
