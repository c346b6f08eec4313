import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF, same
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import bpe, decontaminate, fingerprints, html_text, language, mixing, near_dedup, quality, queries, sharding, token_counts, token_files
from corvane.llm._common import Scratch

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")
#: Nulls, empty and white texts, repeated rows, one very long text, and columns whose names the operators use inside.
ROWS = [(1, None, "en", None), (2, "", "en", "a"), (3, " \n\t", None, "b"), (4, "the cat sat on the mat and that was that", "en", "a"), (4, "the cat sat on the mat and that was that", "en", "a"), (5, "word " * 30_000, "en", "c"), (None, "no id here", "en", "a"), (7, "日本語の文 ñandú <|endoftext|>", "es", "b")]
SCHEMA = "doc_id long, text string, lang string, source string, score string, fingerprint int, kept string, doc string, n_tokens int, size string, shard_rows int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "s", 1, "k", "d", 2, "z", 3) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    same(spark, duck, queries.QUERIES[name], queries.ORACLE_SQL[name])


# fingerprints


def test_fingerprints_with_next(spark, odd):
    def check(df, rows):
        got = sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.n_chars))
        rows = sorted([(r[0], r[1] or "") for r in rows], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        assert len(got) == len(rows)
        for r, (doc_id, text), (_, after) in zip(got, rows, rows[1:] + rows[:1]):
            half = len(text) // 2
            edited = text[: len(text) - half] + after[:half]
            own, of_edited, of_next = map(fingerprints.signature, (text, edited, after))
            assert (r.doc_id, r.n_chars, r.edited_sha256) == (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest())
            assert (r.fingerprint, r.edited_fingerprint) == (fingerprints.to_hex(own), fingerprints.to_hex(of_edited))
            assert (r.near_edited, r.near_next) == (fingerprints.likeness(own, of_edited), fingerprints.likeness(own, of_next))

    check(fingerprints.fingerprints_with_next(odd), ROWS)
    check(fingerprints.fingerprints_with_next(odd.where("doc_id = 5")), [ROWS[5]])
    assert fingerprints.fingerprints_with_next(odd.limit(0)).count() == 0
    assert fingerprints.fingerprint(odd).count() == len(ROWS)


def test_phrases_and_likeness():
    assert fingerprints.phrases("a b a b a b a") == {" a", " b", " a b", " a b a"}
    rng = random.Random(1)
    text = " ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(3000))
    near = text[:2000] + text[2050:]
    a, b = fingerprints.phrases(text), fingerprints.phrases(near)
    true = len(a & b) / len(a | b)
    assert abs(fingerprints.likeness(fingerprints.signature(text), fingerprints.signature(near)) - true) < 0.25
    assert fingerprints.likeness([], []) == 1 and fingerprints.likeness([], [1]) == 0


def plain_phrases(text):
    """A dictionary parse by longest match over the list of symbols, with no state but the phrases."""
    symbols = re.findall(r"[^\W\u2e80-\uffff]{1,16}|[\u2e80-\uffff]|[^\w\s]", text)
    seen, i = set(), 0
    while i < len(symbols):
        j = i + 1
        while j < len(symbols) and tuple(symbols[i:j]) in seen:
            j += 1
        seen.add(tuple(symbols[i:j]))
        i = j
    return seen


def test_likeness_of_many_pairs_against_a_plain_parse(docs):
    texts = [r.text for r in docs.where("text IS NOT NULL").orderBy("doc_id").limit(60).collect()]
    rng, off = random.Random(3), []
    for text, other in zip(texts, texts[1:] + texts[:1]):
        at = rng.randrange(len(text) + 1)
        for near in (text, other, text[:at] + other[at:], text[at:], text[:at] + " inserted words here " + text[at:]):
            a, b = plain_phrases(text), plain_phrases(near)
            assert len(fingerprints.phrases(text)) == len(a)
            got = fingerprints.likeness(fingerprints.signature(text), fingerprints.signature(near))
            off.append(got - (len(a & b) / len(a | b) if a | b else 1))
            assert near != text or got == 1
    assert len(off) == 300 and max(map(abs, off)) < 0.25 and abs(sum(off)) / len(off) < 0.01  # 64 hashes: 0.0625 is one deviation at most
    assert (sum(x * x for x in off) / len(off)) ** 0.5 < 0.0625


# near duplicates


def brute_components(rows, k):
    sets = {}
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        sets[doc] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    root = {d: d for d in sets}
    find = lambda d: d if root[d] == d else find(root[d])
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("k,small,stars,ids", [(2, 64, 8, 10**6), (5, 64, 8, 0), (2, 2, 1, 0), (5, 1, 1, 10**6)])
def test_near_copies_of_one_text(spark, monkeypatch, k, small, stars, ids):
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", ids)  # more are joined by a shuffle
    monkeypatch.setattr(near_dedup, "SMALL", small)  # larger buckets are compared in blocks
    monkeypatch.setattr(near_dedup, "STARS", stars)
    monkeypatch.setattr(near_dedup.large_bucket_links, "__defaults__", (7,))
    rng = random.Random(k)
    base = [rng.choice(["ab", "cd", "ef", "gh"]) + str(rng.randint(0, 99)) for _ in range(120)]
    rows = [(i, " ".join("X%d" % rng.randint(0, 9) if rng.random() < p else w for w in base)) for i in range(120) for p in [rng.choice([0, 0.01, 0.03, 0.08])]]
    rows += [(200, "one"), (201, "ONE"), (202, "a b c"), (203, "a b c d e"), (204, None), (205, "")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=k).collect()}
    assert got == brute_components(rows, k)


def test_components_both_ways(spark):
    edges = [(i, i + 1) for i in range(40) if i % 9] + [(0, 50), (50, 60)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = [{(r.doc, r.component) for r in near_dedup.components(df, Scratch(spark, "t"), "x", one_task=n).collect()} for n in (10**6, 0)]
    assert got[0] == got[1] and (60, 0) in got[0] and (8, 1) in got[0]


def test_near_duplicates_of_odd_rows(spark, odd):
    got = near_dedup.near_duplicates(odd, shingle=2).collect()
    assert len(got) == len(ROWS)
    assert {(r.doc_id, r.n_shingles) for r in got} >= {(1, 0), (2, 0), (3, 0), (5, 1), (None, 2)}
    assert near_dedup.near_duplicates(odd.limit(0)).count() == 0
    assert near_dedup.keep_one(odd).columns == odd.columns and near_dedup.keep_one(odd).count() == len(ROWS)


def test_keep_one_of_copies_without_id_or_with_a_repeated_id(spark):
    long = " ".join(f"w{i}" for i in range(100))
    rows = [(1, "a b c d e f", "x"), (None, "A b c d e f", "y"), (None, long, "x"), (None, long, "y"), (None, long + " end", "z"), (7, "six of one", "x"), (7, "six of one", "y"), (7, "a b c d e f", "z"), (8, "", "x"), (8, "", "y"), (None, None, "x"), (None, None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [tuple(r) for r in near_dedup.keep_one(df.where("source <> 'z' OR doc_id IS NULL"), repeats=False).collect()]
    assert sorted((r[0] or 0, r[1] or "") for r in got if r[1] not in (long, long + " end")) == [(0, ""), (0, ""), (1, "a b c d e f"), (7, "six of one"), (8, ""), (8, "")]
    assert sum(r[1] in (long, long + " end") for r in got) == 1 and set(got) <= set(rows)


# mixing


def test_mix(spark, odd):
    got = mixing.with_copies(odd).collect()
    assert len(got) == len(ROWS) and all(r.__getitem__("__copies") in (0, 1, 2) for r in got)
    assert sum(r["__size"] for r in got if r.doc_id in (1, 2, 3)) == 0
    assert mixing.mix(odd).columns == odd.columns and mixing.with_copies(odd.limit(0)).count() == 0
    rows = [(i, "w " * (1 + i % 50), f"s{i % 4}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {}
    for r in mixing.with_copies(df).collect():
        size, target, _ = taken.get(r.source, (0, 0, 0))
        taken[r.source] = (size + r["__copies"] * r["__size"], r["__target"], r["__source_size"])
    total = sum(s for _, _, s in taken.values())
    assert abs(sum(t for _, t, _ in taken.values()) - 1.5 * total) < 1
    assert all(abs(s - t) <= 50 and t <= 2 * own for s, t, own in taken.values())
    assert sorted(map(tuple, mixing.mix(df).collect())) == sorted(map(tuple, mixing.mix(df.repartition(3)).collect()))


# tokens


@pytest.mark.parametrize("text", ["a   b", "a  \nb", "a \n b", "a\n \nb", "x ", "x  ", "\n x", " x", "a\n ", "<|endoftext|> hi <|endoftext|>", "²³ ½ a b٣ 汉字 don't I'LL", "\x1c \x1d", "a\x85 b", "\xa0 \xa0", "", "z" * 5000])
def test_counts_and_ids_of_odd_texts(text):
    want = tokenizers.Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert bpe.counter(PATH).count(text) == len(want)
    assert np.frombuffer(token_files.encoder(PATH)(text), "<u2").tolist() == want


def test_batches_of_texts_cut_at_marks_and_lines():
    library, rng = tokenizers.Tokenizer.from_file(PATH), np.random.default_rng(3)
    atoms = ["a", "word", "The", "é", "Đư", "Я", "'s", "'", ".", "...", "-", "_", "1", "²", "汉", "\n", ".\n", "\n\n", "\r\n", "\t", " ", " b", "\u0301", "\x01", "\x0b", "\xa0", "<|endoftext|>"]
    texts = ["".join(rng.choice(atoms, rng.integers(0, 14))) for _ in range(4000)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert bpe.counter(PATH).counts(pa.array(texts)).tolist() == list(map(len, want))
    parts = [ids[a:b].tolist() for ids, upto in token_files.encoder(PATH).encode(pa.array(texts), 0) for a, b in zip(upto, upto[1:])]
    assert parts == [ids + [0] for ids in want]


def test_token_counts(spark, odd, docs):
    library = tokenizers.Tokenizer.from_file(PATH)
    for df, rows in ((odd, [r[:2] for r in ROWS]), (docs, [tuple(r) for r in docs.select("doc_id", "text").collect()])):
        want = sorted((i is not None, i or 0, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
        got = token_counts.token_counts(df, PATH).collect()
        assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 512) for r in got)


def test_code_lengths():
    assert token_files.code_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0]
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55])
    free, tight = token_files.code_lengths(counts), token_files.code_lengths(counts, 4)
    heap, cost = sorted(counts.tolist()), 0
    while len(heap) > 1:
        cost += heap[0] + heap[1]
        heap = sorted([heap[0] + heap[1], *heap[2:]])
    assert (free * counts).sum() == cost and tight.max() == 4
    for lengths in (free, tight):
        assert sum(2.0 ** -int(n) for n in lengths) == 1
    rng = np.random.default_rng(0)
    counts = rng.zipf(1.3, 5000)
    lengths = token_files.code_lengths(counts)
    ids = rng.integers(0, 5000, 3000)
    blocks = [(*token_files.encode(x, lengths, token_files.canonical(lengths)), len(x)) for x in (ids[:1], ids[1:700], ids[700:])]
    got = token_files.decode(blocks, token_files.decode_table(lengths))
    assert np.concatenate(got).tolist() == ids.tolist()
    assert token_files.decode(blocks[1:2], token_files.decode_table(lengths))[0].tolist() == ids[1:700].tolist()


def test_token_files(spark, odd, docs, tmp_path):
    library = tokenizers.Tokenizer.from_file(PATH)
    for name, df in (("odd", odd), ("docs", docs)):
        token_files.write_ids(df, str(tmp_path / name), PATH)
        got = sorted(token_files.read_ids(spark, str(tmp_path / name), digest=True).collect(), key=lambda r: r.start)
        rows = sorted([(r.doc_id is not None, r.doc_id or 0, r.text or "") for r in df.collect()])
        at = 0
        assert len(got) == len(rows)
        for r, (known, doc_id, text) in zip(got, rows):
            ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
            assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id if known else None, at, len(ids), zlib.crc32(ids.tobytes()))
            at += len(ids)
    token_files.write_ids(odd.limit(0), str(tmp_path / "none"), PATH)
    assert token_files.read_ids(spark, str(tmp_path / "none")).count() == 0


# shards


def test_shards(spark, odd, docs):
    store = sharding.shard_documents(docs, Scratch(spark, "s").path("store"), target_bytes=40_000, fan_in=2)
    shards = store.manifest()
    assert sum(s["rows"] for s in shards) == docs.count() and not store.plan(shards)
    assert store.read().drop("shard").exceptAll(docs).count() == 0
    many = sharding.ShardStore(spark, Scratch(spark, "s").path("store"), docs.schema, target_bytes=60_000, fan_in=2)
    many.append(docs.repartition(24))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # several groups in one task
    many.compact()
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(many.manifest()) > 3 and many.read().count() == docs.count() and many.read().drop("shard").exceptAll(docs).count() == 0
    assert {r.shard: r["count"] for r in many.read().groupBy("shard").count().collect()} == {s["shard"]: s["rows"] for s in many.manifest()}
    base = store.version()
    store.commit(base, shards)
    with pytest.raises(sharding.Conflict):
        store.commit(base, shards)
    other = sharding.shard_documents(odd, Scratch(spark, "s").path("store"))
    assert other.read(shard="__shard").drop("__shard").exceptAll(odd).count() == 0 and other.read(shard="__shard").count() == len(ROWS)
    none = sharding.shard_documents(odd.limit(0), Scratch(spark, "s").path("store"))
    assert none.read().count() == 0


def test_merges_keep_older_versions(spark, docs):
    store = sharding.ShardStore(spark, Scratch(spark, "s").path("store"), docs.schema, target_bytes=60_000, fan_in=2)
    old = store.append(docs.repartition(8))
    store.compact()
    assert store.version() > old
    assert all(store.read(v).drop("shard").exceptAll(docs).count() == 0 and store.read(v).count() == docs.count() for v in range(old, store.version() + 1))
    assert store.vacuum() == []  # all are recent
    newest = store.version()
    assert store.vacuum(versions=2, seconds=0) == list(range(1, newest - 1))
    assert store.read().count() == store.read(newest - 1).count() == docs.count()
    with pytest.raises(Exception):
        store.read(old).count()


def test_a_vacuum_between_an_append_and_its_commit(spark, docs, monkeypatch):
    store = sharding.ShardStore(spark, Scratch(spark, "s").path("store"), docs.schema, target_bytes=60_000, fan_in=2)
    half = docs.where("doc_id % 2 = 0")
    store.append(half.repartition(4))
    commit, crossed = store.commit, []

    def late(base, shards):
        if not crossed:  # another writer merges, commits and cleans up meanwhile
            crossed.append(1)
            other = sharding.ShardStore(spark, store.folder, docs.schema, target_bytes=60_000, fan_in=2)
            other.compact()
            other.vacuum(versions=1, seconds=0)
        return commit(base, shards)

    monkeypatch.setattr(store, "commit", late)
    store.append(docs.where("doc_id % 2 = 1"))
    assert store.read().count() == docs.count() and store.read().drop("shard").exceptAll(docs).count() == 0
    assert len({s["shard"] for s in store.manifest()}) == len(store.manifest())


def test_plans_against_a_plain_model(spark, docs):
    store = sharding.ShardStore(spark, "/tmp/none", docs.schema, target_bytes=1000, fan_in=3)
    assert [store.tier(n) for n in (1000, 5000, 999, 334, 333, 112, 111, 0)] == [0, 0, 1, 1, 2, 2, 3, 7]
    rng = random.Random(2)
    for _ in range(200):
        shards = [{"shard": i, "bytes": rng.choice([3, 40, 150, 400, 900, 1200])} for i in range(rng.randint(0, 30))]
        plan = store.plan(shards)
        used = [s["shard"] for g in plan for s in g]
        assert len(used) == len(set(used))
        for g in plan:
            tiers, total = {store.tier(s["bytes"]) for s in g}, sum(s["bytes"] for s in g)
            assert len(tiers) == 1 and 0 not in tiers and len(g) > 1 and total - g[-1]["bytes"] < 1000 and (total >= 1000 or len(g) >= 3)
        for t in {store.tier(s["bytes"]) for s in shards} - {0}:
            run = [s["shard"] for s in shards if store.tier(s["bytes"]) == t]
            groups = [[s["shard"] for s in g] for g in plan if store.tier(g[0]["bytes"]) == t]
            assert (bool(groups) or len(run) < 3) and run[: sum(map(len, groups))] == [x for g in groups for x in g]


def test_merges_shuffle_no_rows(spark, docs, monkeypatch):
    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    monkeypatch.setattr(sharding, "MERGE_GROUPS", 2, raising=False)  # several jobs
    store = sharding.ShardStore(spark, Scratch(spark, "s").path("store"), docs.schema, target_bytes=60_000, fan_in=2)
    store.append(docs.repartition(24))
    groups, before = store.plan(store.manifest()), shuffled()
    store.compact()
    merged = [s for s in store.manifest() if s["generation"]]
    assert len(groups) > 2 and shuffled() - before < 0.2 * sum(s["bytes"] for s in merged)
    assert all(s["bytes"] < 4 * 60_000 for s in merged)  # a file for each group
    assert spark.conf.get("spark.sql.unionOutputPartitioning", "true") == "true"
    assert store.read().count() == docs.count() and store.read().drop("shard").exceptAll(docs).count() == 0


def test_shards_of_clashing_columns(spark):
    df = spark.createDataFrame([(i, "t", "f", 1, 2) for i in range(50)], "doc_id long, c1 string, file string, task int, n int").repartition(8)
    store = sharding.ShardStore(spark, Scratch(spark, "s").path("store"), df.schema, target_bytes=1 << 20, fan_in=2)
    store.append(df)
    store.compact()
    assert len(store.manifest()) == 1 and store.read(shard="number").drop("number").exceptAll(df).count() == 0


# quality and language


def test_quality(spark, odd, docs):
    labels = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/labels.parquet")
    more = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/documents.parquet")
    model = quality.fit(more, labels)
    got = quality.quality_scores(more, model).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.97
    scores = quality.quality_scores(odd, model).collect()
    assert len(scores) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scores)
    empty = quality.fit(more, labels.limit(0))
    assert 0 <= quality.quality_scores(odd, empty).first().score <= 1
    assert quality.keep_good(odd, model).columns == odd.columns


def test_scores_against_plain_sums(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0.5)).astype(float)
    model = quality.fit_arrays(x, y)
    for row, score in zip(x[:40].tolist(), model.score(x[:40]).tolist()):
        at = [sum(v >= e for e in edges) for v, edges in zip(row, model.edges)]
        total = model.base + sum(float(t[i]) for t, i in zip(model.tables, at)) + sum(float(t[at[f], at[g]]) for f, g, t in model.pairs)
        assert score == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((model.score(x) >= 0.5) == y).mean() > 0.9 and len(model.pairs) == quality.PAIRS
    g, h = rng.normal(size=12), rng.uniform(0.5, 2, 12)
    want = max((g[:k].sum() ** 2 / (h[:k].sum() + 1) + g[k:].sum() ** 2 / (h[k:].sum() + 1) - g.sum() ** 2 / (h.sum() + 1), k) for k in range(1, 12) if h[:k].sum() > 1 and h[k:].sum() > 1)
    assert quality._split(g, h) == (pytest.approx(want[0]), want[1])
    tree = quality._tree(g, h)
    cuts = np.flatnonzero(np.diff(tree)) + 1
    assert len(cuts) <= 2 and all(np.allclose(tree[a:b], g[a:b].sum() / (h[a:b].sum() + 1)) for a, b in zip([0, *cuts], [*cuts, 12]))


def test_operators_on_empty_tables(spark, odd):
    none = odd.limit(0)
    model = quality.fit_arrays(np.zeros((0, len(quality.FEATURES))), np.zeros(0))
    assert quality.quality_scores(none, model).count() == quality.keep_good(none, model).count() == 0
    assert language.identify(none, language.fit(none)).count() == 0
    assert token_counts.token_counts(none, PATH).count() == 0
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.with_occurrences(none, bench).count() == decontaminate.with_occurrences(none, bench, block_words=1).count() == 0


def test_mixing_of_hot_sizes_and_clashing_columns(spark, monkeypatch):
    rows = [(i, "w " * (3 if i % 3 else i % 200), "a" if i % 4 else "b", 1, 2, "x") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, k int, copies int, __size string")
    plain = {(r.doc_id): r["__copies"] for r in mixing.with_copies(df.drop("__size")).collect()}
    monkeypatch.setattr(mixing, "DIGITS", 1)
    monkeypatch.setattr(mixing, "BLOCK", 2)
    assert {(r.doc_id): r["__copies"] for r in mixing.with_copies(df.drop("__size")).collect()} == plain
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(plain.values())


def test_most_frequent_is_of_the_whole_text():
    at = quality.FEATURES.index("most_frequent")
    texts = [" ".join([*map(str, range(40)), *["late"] * 60]), " ".join(f"w{i} odd" for i in range(50)), "one", "", None]
    assert [quality.features(t)[at] for t in texts] == [0.6, 0.5, 1.0, 0.0, 0.0]


def test_language(spark, odd):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language.fit(docs.where(~held))
    got = language.identify(docs.where(held), model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.98
    by_id = {r.doc_id: r for r in language.identify(odd, model).collect()}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (1, 2, 3)) and by_id[4].lang_pred in model.langs
    assert language.identify(odd, language.fit(odd.limit(0))).first().lang_pred == "und"
    en = docs.where("lang = 'en'").first().text[:600]
    de = docs.where("lang = 'de'").first().text[:600]
    spans = language.Labeller(model).labels([en + " " + de])[0][2]
    assert [s[2] for s in spans] == ["en", "de"]


def test_viterbi_against_brute_force():
    labeller = language.Labeller(language.Model(["a", "b", "c"], np.zeros((language.BUCKETS, 3)), {x: set() for x in "abc"}))
    rng = np.random.default_rng(3)
    for _ in range(30):
        s = rng.normal(0, 12, (6, 3)).astype("float32")
        worth = lambda p: sum(s[i, k] for i, k in enumerate(p)) - language.PENALTY * sum(x != y for x, y in zip(p, p[1:]))  # noqa: B023, E731
        best = max(worth(p) for p in itertools.product(range(3), repeat=6))
        assert abs(worth(labeller.path(s)) - best) < 1e-3


# pages and benchmark


def test_pages(spark):
    page = "<html><head><title>t</title></head><body><nav><a href=x>menu</a></nav><div class='cookie-notice'>accept</div><article><h1>A &amp; B</h1><p>one\n two<br>three<p>four&nbsp;five <b>six</b></p><script>var x='</p>'</script><form>mail</form></article><div id=comments><p>a very long comment of a reader that goes on and on and on and on</p></div><aside>side</aside><footer>foot</footer></body></html>"
    assert html_text.main_text(page) == "A & B\n\none two three\n\nfour five six"
    assert [html_text.main_text(x) for x in (None, "", "<", "<nav>x</nav>", "plain text")] == ["", "", "<", "", "plain text"]
    df = spark.createDataFrame([(1, "u", page, 1), (2, None, None, 2)], "page_id long, url string, html string, text int")
    assert {r.page_id: r.n_chars for r in html_text.page_texts(df).collect()} == {1: 35, 2: 0}


def test_pages_of_divs_only():
    first, second = ("first words of it " * 20).strip(), ("then more of it all " * 34).strip()
    page = f"<html><body><div class=menu>menu</div><div id=content><h1>Title</h1><div><p>{first}</p></div><div><p>{second}</p></div></div><div class=footer>foot</div></body></html>"
    assert html_text.main_text(page) == f"Title\n\n{first}\n\n{second}"
    quoted = f"<html><body><div id=content><p>short</p><p>{first}</p><blockquote><p>{first}</p><p>{first}</p></blockquote></div></body></html>"
    assert html_text.main_text(quoted) == "\n\n".join(["short", first, first, first])


WORDS = "some words of an article that go on for a while "
UNNAMED = f"<body><div><p>Home, news</p><p>Sport</p></div><div><h2>Title</h2><p>{WORDS * 9}</p><p>short</p><p>{WORDS * 7}</p></div><div><p>Terms</p><p>About us</p></div></body>"


@pytest.mark.parametrize("page,want", [
    ("<div class='layout has-sidebar'><article><h1>A</h1><p>text</p></article></div>", "A\n\ntext"),
    ("<div class='content no-comments'><article><p>text of it</p></article></div>", "text of it"),
    ("<body><form id=f><nav>menu</nav><div><article><p>some text</p><p>x</p></article></div><footer>foot</footer></form></body>", "some text\n\nx"),
    ("<div id=comments-wrap><article><p>" + WORDS * 5 + "</p></article><p>a note</p></div><div class=comment>" + WORDS * 3 + "</div>", (WORDS * 5).strip() + "\n\na note"),
    ("<body><div id=c><h1>T</h1><ul>" + "".join(f"<li><a href=/{i}>link number {i}</a></li>" for i in range(30)) + f"</ul><p>{WORDS * 9}</p><p>short</p></div></body>", f"T\n\n{(WORDS * 9).strip()}\n\nshort"),
    ("<article><p>" + WORDS + "</p><div class=ad>" + WORDS + "</div><section id=comments><article class=comment><p>" + WORDS * 6 + "</p></article></section></article>", WORDS.strip()),
    ("<p hidden>no</p><p>yes</p><div style='display: none'>no</div></b></i></p>", "yes"),
    (UNNAMED, f"Title\n\n{(WORDS * 9).strip()}\n\nshort\n\n{(WORDS * 7).strip()}"),
])
def test_pages_of_odd_shape(page, want):
    assert html_text.main_text(page) == want


def template_text(page):
    import html
    import re

    article = page[page.index("<article>") : page.index("</article>")]
    return "\n\n".join(filter(None, [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:h1|p)>", article)]))


def test_smoothed_ratios_select_the_region(monkeypatch, spark):
    """Without names all pages stay right. Without the kinds of elements, too, ratios alone find the article of many pages,
    and of fewer without smoothing, or with a flag in place of the ratio."""
    import re

    pages = [r.html for r in spark.read.parquet(f"{SF.replace('0.001', '0.1')}/pages.parquet").select("html").collect()]
    want = list(map(template_text, pages))
    right = lambda: sum(html_text.main_text(p) == w for p, w in zip(pages, want))
    for names in ("_NOISE", "_STRONG"):
        monkeypatch.setattr(html_text, names, re.compile("(?!)"))
    assert right() == len(pages)
    for kinds in ("SUSPECT", "NEVER", "CONTENT"):
        monkeypatch.setattr(html_text, kinds, frozenset())
    monkeypatch.setattr(html_text, "ROOTS", html_text.ROOTS | {"nav", "footer", "aside"})
    by_ratio = right()
    with monkeypatch.context() as m:
        m.setattr(html_text, "smoothed", lambda values: values)
        unsmoothed = right()
    with monkeypatch.context() as m:
        m.setattr(html_text, "ratios", lambda page: [1.0] * len(page.lines))
        flagged = right()
    assert by_ratio > len(pages) / 3 and unsmoothed < by_ratio and flagged < 0.9 * by_ratio


def test_smoothing_keeps_short_lines_between_long_ones(monkeypatch):
    page = f"<body><div><p>{WORDS * 8}</p></div><div><h4>Sub</h4><p>x</p></div><div><p>{WORDS * 8}</p></div><div><p>a</p></div><div><p>b</p></div></body>"
    with monkeypatch.context() as m:
        m.setattr(html_text, "smoothed", lambda values: values)
        assert "x" not in html_text.main_text(page).split("\n\n")
    assert "x" in html_text.main_text(page).split("\n\n")
    assert html_text.smoothed([1, 1, 1]) == pytest.approx([1, 1, 1]) and html_text.threshold([1, 2, 9, 10]) == 5.5


def test_names_break_ties_only():
    short = "<article><h1>Short</h1><p>Only this sentence.</p></article>"
    for beside in (f"<div>{WORDS * 9}</div>", f"<div class='thread'><p>{WORDS * 9}</p><p>{WORDS * 4}</p></div>"):
        assert html_text.main_text(f"<body>{short}{beside}</body>") == "Short\n\nOnly this sentence."
        assert html_text.main_text(f"<body><div id=x>{short}{beside}</div></body>") == "Short\n\nOnly this sentence."
    around = lambda x: f"<body><nav><a href=/>m</a></nav><article><h1>T</h1><p>{WORDS * 5}</p>{x}<p>{WORDS * 3}</p></article>"
    for part in ("<p class='widget'>{}</p>", "<section id='notices'><p>{}</p></section>", "<div class='social-history'>{}</div>", "<p id='alert-1'>{}</p>", "<section id='related-work'><p>{}</p></section>", "<p><a href=/>{}</a></p>"):
        assert "keep me" in html_text.main_text(around(part.format("keep me")))
    for part in (f"<section class='discussion'><p>{WORDS * 9} bad</p></section>", "<div class='share-this'>Share this bad</div>", "<div>Share this: <a href=x>Twitter bad</a> <a href=y>Facebook</a></div>", f"<div class='ad-slot-1'>{WORDS} bad</div>"):
        assert "bad" not in html_text.main_text(around(part)) and html_text.main_text(around(part)).endswith((WORDS * 3).strip())
    assert "bad" not in html_text.main_text(around("") + f"<section class='discussion'><p>{WORDS * 9} bad</p></section>")
    for body in (f"<div id=c><h1>T</h1><p>{WORDS * 5}</p><p>{WORDS * 3}</p></div>", f"<article><p>{WORDS * 5}</p></article>"):
        assert "bad" not in html_text.main_text(f"<body>{body}<div id='foot'>Copyright bad 2020 all of it</div></body>")


def test_very_long_pages_and_empty_tables(spark):
    body = "".join(f"<p>{WORDS * 3} {i}</p>" for i in range(20_000))
    got = html_text.main_text(f"<body><nav><a href=/>x</a></nav><article>{body}</article></body>")
    assert got.count("\n\n") == 19_999 and got.endswith("19999")
    assert html_text.main_text("<div>" * 20_000 + "deep" + "</b></div>" * 20_000) == "deep"
    assert html_text.page_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_against_the_templates(spark):
    import html
    import re

    pages = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.page_texts(pages).collect()}
    for r in pages.collect():
        article = r.html[r.html.index("<article>") : r.html.index("</article>")]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:h1|p)>", article)]
        assert got[r.page_id] == "\n\n".join(filter(None, blocks))


def test_wu_manber_against_brute_force(spark, odd):
    rng = random.Random(5)
    for _ in range(40):
        text = [rng.choice([b"a", b"b", b"c"]) for _ in range(80)]
        items = [(i, " ".join(rng.choice("abc") for _ in range(rng.choice([0, 1, 2, 3, 5, 7])))) for i in range(5)]
        spans, found = decontaminate.occurrences(text, decontaminate.matchers(items, 4))
        hit, want = set(), set()
        for i, t in items:
            w = decontaminate.words(t)
            m = min(4, len(w))
            for j in range(len(w) - m + 1 if w else 0):
                for k in range(len(text) - m + 1):
                    if text[k : k + m] == w[j : j + m]:
                        hit |= set(range(k, k + m))
                        want.add(i)
        assert {p for a, b in spans for p in range(a, b)} == hit and set(found) == want
    bench = spark.createDataFrame([(1, "CAT sat, on"), (2, None), (None, "mat")], "item_id long, text string")
    once = decontaminate.with_occurrences(odd, bench).select("doc_id", "__found").collect()
    blocks = decontaminate.with_occurrences(odd, bench, block_words=1).select("doc_id", "__found").collect()
    key = lambda r: str(r)
    assert sorted(once, key=key) == sorted(blocks, key=key)
    assert {r.doc_id for r in once if r["__found"]["spans"]} == {4}
    assert decontaminate.clean(odd, bench).count() == len(ROWS) - 2 and decontaminate.clean(odd, bench.limit(0)).count() == len(ROWS)


# pipeline


def test_pipeline(spark):
    sf = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, counts = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        kept = Scratch(spark, "t").write(stage(spark, kept, sf), "x")
        counts.append(kept.count())
        assert name == "sharding" or kept.columns == docs.columns
        if name == "near duplicates":
            rows = [(r.doc_id, r.text) for r in kept.collect()]
            assert all(d == c for d, (_, c) in brute_components(rows, 5).items())
        if name == "decontamination":
            bench = spark.read.parquet(f"{sf}/benchmark.parquet")
            assert decontaminate.clean(kept, bench).count() == counts[-1]
    assert counts[1] < counts[0] and counts[5] == counts[4]
    got = corpus_pipeline.run(spark, sf)
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in kept.collect())
