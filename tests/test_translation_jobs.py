import json

import pytest
from pyspark.sql import functions as F

from corvane import jobs as cli
from corvane.operators import curate, memory, translate
from corvane.sources import ordinals, records
from corvane.sources.versions import Conflict, Versions
from corvane.streaming import ledger


def counting(spark, change):
    """A translator of batches, and the texts it was given."""
    seen = spark.sparkContext.accumulator(0)

    def of(texts):
        seen.add(len(texts))
        return [change(t) for t in texts]

    return translate.batched(of), seen


# ordinals


def test_numbers_in_order_of_files(spark, tmp_path):
    spark.range(100).select("id", F.concat(F.lit("text "), "id").alias("at")).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    plain = {r.id: i for r, i in one.rdd.zipWithIndex().collect()}
    got = ordinals.numbered(one, "n")
    assert {r.id: r.n for r in got.collect()} == plain and got.columns == ["id", "at", "n"]
    assert "Python" not in got._jdf.queryExecution().toString()
    lines = [json.dumps({"id": i}) for i in range(500)]
    (tmp_path / "many").mkdir()
    for k in range(3):  # blank lines are no records
        (tmp_path / "many" / f"{2 - k}.json").write_text("\n".join(["", *lines[100 * k : 100 * k + 100 + k], "", ""]))
    read = records.read_records(spark, str(tmp_path / "many"))
    want = [*range(200, 302), *range(100, 201), *range(100)]  # files by path
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("100", before):  # in many pieces, and in one for each file
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        read = records.read_records(spark, str(tmp_path / "many"))
        assert [r.id for r in ordinals.numbered(read).orderBy("ordinal").collect()] == want
        assert sorted(r.ordinal for r in ordinals.numbered(read).collect()) == list(range(len(want)))
    made = ordinals.numbered(spark.range(10, numPartitions=3).toDF("ordinal_"))
    assert sorted(map(tuple, made.collect())) == [(i, i) for i in range(10)]
    assert ordinals.numbered(spark.range(0)).count() == 0


# versions and the memory


def test_of_two_writers_with_one_base_one_wins(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "v"))
    assert v.newest() == 0 and v.read(0, "none") == "none"
    v.commit(0, ["a"])
    with pytest.raises(Conflict):
        v.commit(0, ["b"])
    assert v.update(lambda x: [*x, "c"]) == ["a", "c"] and v.newest() == 2
    for _ in range(20):
        v.update(lambda x: x)
    assert len(list((tmp_path / "v").glob("v*.json"))) == 9 and v.read(22) == ["a", "c"]


def test_memory_keeps_entries_of_all_writers(spark, tmp_path, monkeypatch):
    entries = lambda *rows: spark.createDataFrame(rows, memory.SCHEMA)
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    m, other = (memory.TranslationMemory(spark, str(tmp_path / "m")) for _ in range(2))
    assert m.lookup(keys("a")).count() == 0
    commit = m.versions.commit

    def crossed(base, value):  # the other writer commits between this one's look and its commit
        monkeypatch.setattr(m.versions, "commit", commit)
        other.merge(entries(("b", "other", None), ("a", "late", None)))
        return commit(base, value)

    m.merge(entries(("a", "first", None)))
    monkeypatch.setattr(m.versions, "commit", crossed)
    m.merge(entries(("c", None, "placeholder"), ("b", "mine", None)))
    found = lambda of: sorted(map(tuple, of.lookup(keys("a", "b", "c", "d")).collect()))
    want = [("a", "first", None), ("b", "other", None), ("c", None, "placeholder")]
    assert found(m) == found(other) == want and len(m.segments()) == 3
    stale = m.segments()
    assert m.compact() and len(m.segments()) == 1 and found(other) == want
    assert not other.compact(stale)  # those are merged already; nothing changes
    assert found(m) == want and len(m.vacuum()) == 3 and found(m) == want
    monkeypatch.setattr(memory, "SEGMENTS", 2)
    m.merge(entries(("d", "new", None)))
    assert len(m.segments()) == 1 and len(found(m)) == 4


# the gate


def test_second_pass_gets_refused_rows_only(spark):
    rows = [(i, f"source text {i}", "x") for i in range(40)] + [(40, None, "x")]
    df = spark.createDataFrame(rows, "id int, s string, one string")
    number = lambda t: int(t.split()[-1])
    first, n1 = counting(spark, lambda t: t if number(t) % 4 == 0 else f"dịch {t}")
    again, n2 = counting(spark, lambda t: t if number(t) % 8 == 0 else f"<think>x</think> lại {t}")
    out = {r.id: r for r in curate.gated(df, "s", first, lambda s, why: again(s), "out").collect()}
    assert (n1.value, n2.value) == (40, 10)
    assert out[1].out == "dịch source text 1" and out[4].out == "lại source text 4" and out[8].out == "source text 8"
    assert {i for i, r in out.items() if r.fault} == {0, 8, 16, 24, 32} and out[8].fault == "untranslated" and out[40].out is None and out[40].fault is None
    fine, n1 = counting(spark, lambda t: f"dịch {t}")
    again, n2 = counting(spark, lambda t: t)
    assert curate.gated(df, "s", fine, lambda s, why: again(s), "out").where("fault IS NULL").count() == 41 and n2.value == 0


def test_staged_translation_with_a_memory(spark, tmp_path):
    rows = [(i, f"play Nf3 on move {i % 6}", "white beats white" if i % 2 else None, 0) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, question string, answer string, mask0 int")
    known = memory.TranslationMemory(spark, str(tmp_path / "memory"))
    bad = lambda t: "white" in t and not t.startswith("DỊCH")
    of, seen = counting(spark, lambda t: t if bad(t) else "Đ " + t.rpartition("\n")[2].replace("white", "trắng"))
    out, texts = translate.translated_with_texts(df, of, ["question", "answer"], memory=known, fen=None, terms={}, variants={})
    got = {r.id: r for r in out.collect()}
    assert got[1].question == "Đ play Nf3 on move 1" and got[1].answer == "Đ trắng beats trắng" and got[2].answer is None
    assert out.columns == df.columns and seen.value == 8 and texts.count() == 7  # seven texts, one of them twice
    of, again = counting(spark, lambda t: "never")
    out, texts = translate.translated_with_texts(df, of, ["question", "answer"], memory=known, fen=None, terms={}, variants={})
    assert {r.id: r for r in out.collect()} == got and again.value == 0 and texts.count() == 0
    lazy, n = counting(spark, lambda t: t)
    out, texts = translate.translated_with_texts(df, lazy, ["answer"], fen=None, terms={}, variants={})
    assert {r.fault: r.n for r in translate.faults(texts).collect()} == {"colours": 1} and n.value == 2  # its echo holds the hint
    assert {r.answer for r in out.collect()} == {None, "white beats white"}


# the ledger


def test_no_row_is_lost_or_comes_twice(spark, tmp_path):
    spark.range(25).write.parquet(str(tmp_path / "in"))
    rows = ordinals.numbered(spark.read.parquet(str(tmp_path / "in")))
    target = str(tmp_path / "out")
    double = lambda d: d.select("ordinal", (F.col("id") * 2).alias("x"))
    done = ledger.Ledger(spark, target)
    assert done.read() is None
    assert ledger.run_by_rows(rows, double, target, batch=4, limit=6) == 6 and done.state() == {"done": 6, "shards": 2}
    calls = []

    def failing(d):
        calls.append(1)
        if len(calls) in (2, 3):
            raise OSError("lost")
        return double(d)

    waits = []
    with pytest.raises(RuntimeError):  # its second batch fails as often as it is tried
        ledger.run_by_rows(rows, failing, target, batch=4, resume=True, tries=2, sleep=waits.append)
    assert done.state() == {"done": 10, "shards": 3} and waits == [1.0]
    commit = ledger.Ledger.commit

    def killed(self, n, k):  # after the shard, before the ledger
        raise KeyboardInterrupt

    ledger.Ledger.commit = killed
    try:
        with pytest.raises(KeyboardInterrupt):
            ledger.run_by_rows(rows, double, target, batch=8, resume=True)
    finally:
        ledger.Ledger.commit = commit
    assert (tmp_path / "out/part-00003").exists() and done.state()["shards"] == 3 and done.read().count() == 10
    assert ledger.run_by_rows(rows, double, target, batch=4, resume=True) == 15
    assert sorted(map(tuple, done.read().collect())) == sorted((r.ordinal, 2 * r.id) for r in rows.collect()) and done.state() == {"done": 25, "shards": 7}
    assert ledger.run_by_rows(rows, double, target, batch=4, resume=True) == 0 and done.state()["shards"] == 7
    shown = []
    assert ledger.run_by_rows(rows, double, target, dry_run=True, samples=3, show=lambda a, b: shown.append((a.count(), b.count()))) == 3
    assert shown == [(3, 3)] and done.state()["done"] == 25
    assert ledger.run_by_rows(rows, double, target, batch=25) == 25 and done.state() == {"done": 25, "shards": 1} and done.read().count() == 25


def test_translation_from_a_command_line(spark, tmp_path, capsys):
    lines = [json.dumps({"id": i, "question": f"q {i % 3} rook", "answer": "a"}) for i in range(10)]
    (tmp_path / "in.jsonl").write_text("\n".join(lines))
    call = lambda *more: cli.main(["translate", "--source", str(tmp_path / "in.jsonl"), "--target", str(tmp_path / "out"), "--batch-rows", "4", "--memory", str(tmp_path / "m"), *more], spark)
    assert cli.main(["translate", "--target", str(tmp_path / "none")], spark) == 2
    assert call("--dry-run") == 0 and not (tmp_path / "out").exists() and "q 1 rook" in capsys.readouterr().out
    assert call("--limit", "5") == 0 and "5 records" in capsys.readouterr().out
    assert call("--resume") == 0 and "5 records" in capsys.readouterr().out
    read = ledger.Ledger(spark, str(tmp_path / "out"))
    assert read.state() == {"done": 10, "shards": 4} and sorted(r.id for r in read.read().collect()) == list(range(10))
    of, seen = counting(spark, lambda t: f"Đ {t}")
    assert cli.translate_rows(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "out"), of, memory=str(tmp_path / "m2"), batch=3) == 0
    assert seen.value == 4 and {r.question for r in read.read().collect()} == {f"Đ q {i} xe" for i in range(3)}
