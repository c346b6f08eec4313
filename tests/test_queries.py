import re
from collections import Counter

import pytest
from conftest import SF, same

from corvane import registry
from corvane.functions import text as T


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    same(spark, duck, registry.QUERIES[name], registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def english_run(text):
    runs = [[]]
    for w in re.findall("[A-Za-zÀ-ỹ]+", text):
        if set(w) & set(T.VIETNAMESE):
            runs.append([])
        else:
            runs[-1].append(w)
    return max(len(r) if sum(w.lower() in T.STOPWORDS for w in r) >= 2 else 0 for r in runs)


def gate(source):
    clean = lambda s: re.sub(r"(?is)<think>.*?</think>", "", s).strip()
    word = lambda w, s: re.findall(rf"(?i)(?<!\w){w}(?!\w)", s)

    def fault(out):
        if re.findall("<[MFN][0-9]+>", source) != re.findall("<[MFN][0-9]+>", out):
            return "placeholder"
        if source == out or english_run(out) >= 8:
            return "untranslated"
        if len(source) >= 200 and len(out) / len(source) < 0.7:
            return "truncated"
        return next(("colours" for en, vi in (("white", "trắng"), ("black", "đen")) if len(word(en, source)) >= 2 and not word(vi, out)), None)

    return fault(clean(re.sub("(?i)(?<![a-z])the(?![a-z])", "những", source))) and fault(clean(source))


def test_translation_gate_reads_whole_texts(spark, tmp_path):
    fine = "the đi " * 200  # 1,400 characters; the first 1,000 alone have no fault
    english = "we are in a big house and it was not far from here"
    texts = [fine, fine + english, fine + "white white ", fine + "<think>" + "x" * 2000 + "</think>", fine + "<think><M1></think>", fine + "the white white trắng", english, "the đi", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda d: {r.fault: r.n for r in registry.QUERIES["translation_gate"](spark, d).collect()}
    assert run(str(tmp_path)) == {"kept": 3, "untranslated": 4, "colours": 1, "truncated": 1, "placeholder": 1}
    for d in (str(tmp_path), SF):
        rows = spark.read.parquet(f"{d}/documents.parquet").select("text").collect()
        assert run(d) == Counter(gate(r.text or "") or "kept" for r in rows)


def test_chess_facts_of_many_positions(spark):
    from pyspark.sql import functions as F

    from corvane.chess.udf import facts_of
    from corvane.plans.queries import placed_by

    fens = {r.doc_id: r.fen for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", placed_by(F.col("doc_id")).alias("fen")).collect()}
    got = {r.doc_id: tuple(r)[1:] for r in registry.QUERIES["chess_facts"](spark, SF).collect()}
    assert len(set(fens.values())) == len(fens) == len(got)
    for i, fen in fens.items():
        f = facts_of(fen)
        assert got[i] == (len(f[2]), *f[9:12], *f[5:7])
