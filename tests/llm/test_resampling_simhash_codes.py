import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from conftest import SF

from corvane.llm import resampling, simhash, vector_codes

FOLD = {c: c + 32 for c in range(65, 91)}
#: Nulls, empty and white texts, repeated rows and ids, one very long text, and columns whose names the operators use inside.
ROWS = [(1, None), (2, ""), (3, " \n\t"), (4, "The cat sat on the mat and that was that " * 3), (4, "The cat sat on the mat and that was that " * 3), (4, "another text of the same id"), (5, "word " * 30_000), (None, "no id here"), (None, "no id here"), (7, "日本語の文 ñandú <|endoftext|>"), (8, "the cat sat on the mat and that was that " * 3 + "x")]
SCHEMA = "doc_id long, text string, id string, score string, rank int, fp string, key string, n_words string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "i", "s", 1, "f", "k", "n") for r in ROWS], SCHEMA)


# importance resampling


def brute_scores(docs, target, percent=25, least=20, buckets=10_000, seed=7):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    runs = lambda w: [zlib.crc32(x.encode()) % buckets for x in w + [" ".join(p) for p in zip(w, w[1:])]]
    s, t = [0] * buckets, [0] * buckets
    for into, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for b in runs(words(x)):
                into[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out, drawn = [], []
    for i, (doc, x) in enumerate(docs):
        own = runs(words(x))
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(own), weight, score, None])
        if len(words(x)) >= least:
            drawn.append((-score, doc is None, doc or 0, weight, len(words(x)), i))
    for rank, (*_, i) in enumerate(sorted(drawn)[: percent * len(drawn) // 100]):
        out[i][4] = rank + 1
    return sorted(map(tuple, out), key=repr)


def test_importance_of_odd_rows(spark, odd):
    target = ["the cat and the dog sat", None, "", "A mat; that was THAT"]
    frame = spark.createDataFrame([(t, 1) for t in target], "text string, n int")
    for percent in (25, 60, 100, 0):
        got = resampling.importance(odd, frame, percent=percent).select("id", "n_features", "weight", "score", "rank").collect()
        assert sorted(map(tuple, got), key=repr) == brute_scores(ROWS, target, percent)
    assert resampling.importance(odd.limit(0), frame).count() == 0
    got = resampling.importance(odd, frame.limit(0)).select("id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=repr) == brute_scores(ROWS, [])
    kept = resampling.resample(odd, frame, percent=100, least=3)
    assert kept.columns == odd.columns and kept.count() == len(ROWS) - 3
    assert resampling.resample(odd, frame, percent=0).count() == 0 == resampling.resample(odd.limit(0), frame).count()


def test_resample_takes_what_is_ranked(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    drawn = {r.id for r in resampling.importance(docs, target).where("rank IS NOT NULL").collect()}
    kept = resampling.resample(docs, target)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == drawn and drawn


def test_ties_go_to_smaller_ids(spark):
    rows = [(i, 30, 5, 100 + i % 3) for i in range(300)]
    got = resampling.ranked(spark.createDataFrame(rows, "id long, n_words long, weight long, score long"), 50).collect()
    want = {r[0]: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: (-r[3], r[0]))[:150])}
    assert {r.id: r["rank"] for r in got if r["rank"]} == want and len(got) == 300


# SimHash


def brute_print(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    if not w:
        return 0
    k = min(k, len(w))
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_classes(prints, radius=4, ids=None):
    """Least id by fingerprint, over distinct fingerprints."""
    root = {p: p for p in prints}
    find = lambda p: p if root[p] == p else find(root[p])
    for a, b in itertools.combinations(root, 2):
        if (a ^ b).bit_count() <= radius:
            root[find(a)] = find(b)
    return {p: find(p) for p in root}


def near_prints(seed, groups, size):
    rng = random.Random(seed)
    out = {rng.getrandbits(64) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(5)}
    for _ in range(groups):
        base = rng.getrandbits(64)
        out |= {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(size)}
    return sorted(out)


def test_tree_finds_all_within_the_radius():
    fp = np.array(near_prints(3, 12, 25), np.uint64)
    key = (fp % np.uint64(3)).astype(np.int64)
    tree = simhash.plant(key, fp)
    assert sorted(tree[1].tolist()) == sorted(fp.tolist())
    roots, fps, first, mask = tree[:4]
    for node in range(len(fps)):  # a child hangs at its distance to the parent
        far = [d for d in range(1, 65) if int(mask[node]) >> (d - 1) & 1]
        assert [(int(fps[node]) ^ int(fps[first[node] + i])).bit_count() for i in range(len(far))] == far
    for radius in (0, 2, 4, 9):
        got = {(int(fp[a]), int(fps[b])) for q, n in simhash.search(tree, fp, key, radius) for a, b in zip(q, n)}
        assert got == {(int(a), int(b)) for a, x in zip(fp, key) for b, y in zip(fp, key) if x == y and (int(a) ^ int(b)).bit_count() <= radius}


@pytest.mark.parametrize("n", [10, 10**7, 10**12])
def test_linked_fingerprints_share_a_key(n):
    masks = simhash.key_masks(n)
    rng = random.Random(n)
    for _ in range(300):
        flip = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(flip & (m % 2**64) == 0 for m in masks)


@pytest.mark.parametrize("tree,most", [(2000, 10**6), (20, 10**6), (20, 0)])
def test_links_in_one_tree_and_across_trees(spark, monkeypatch, tree, most):
    from corvane.llm._common import Scratch
    from corvane.llm.near_dedup import components

    monkeypatch.setattr(simhash, "TREE", tree)
    monkeypatch.setattr(simhash, "BROADCAST", most)
    prints = near_prints(5, 6, 60)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    scratch = Scratch(spark, "t")
    frame = scratch.write(spark.createDataFrame([(signed(p),) for p in prints], "fp long"), "fp")
    edges = scratch.write(simhash.links(frame, scratch), "edges")
    assert edges.count() < 10 * len(prints)
    got = {r.doc % 2**64: r.component for r in components(edges, scratch, "c").collect()}
    want = brute_classes(prints)
    same = lambda of: {frozenset(p for p in prints if of(p) == c) for c in map(of, prints)}
    assert same(lambda p: got.get(p, p)) == same(want.get) and len(same(want.get)) < len(prints)


def test_near_duplicates_of_odd_rows(spark, odd):
    got = simhash.near_duplicates(odd).collect()
    prints = [(d, brute_print(t)) for d, t in ROWS]
    assert sorted((r.doc_id or 0, r.fingerprint) for r in got) == sorted((d or 0, f"{p:016x}") for d, p in prints)
    of = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    assert {of[d, "0" * 16] for d in (1, 2, 3)} == {1}
    assert {c for (d, _), c in of.items() if d == 4} == {4}  # an id's texts are one document
    assert of[None, f"{brute_print('no id here'):016x}"] is None
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_near_duplicates_of_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    own = {d: brute_print(t) for d, t in docs}
    classes = brute_classes(set(own.values()))
    least = {}
    for d, p in own.items():
        least[classes[p]] = min(d, least.get(classes[p], d))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op12_bk_simhash(spark, SF).collect()}
    assert got == {d: (f"{p:016x}", least[classes[p]]) for d, p in own.items()}


# vector codes


def brute_codes(rows, scale, parts, entries, rounds):
    kept = [(i, [math.floor(scale * x) if abs(x) < 2**53 else scale * int(x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], []
    m = len(kept[0][1]) // parts
    cut = [[v[p * m : p * m + m] for p in range(parts)] for _, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (far(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, k in zip(cut, codes) if k[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    codes = assign()
    return sorted(((i, "".join(f"{e:02x}" for e in k), sum(far(c[p], books[p][k[p]]) for p in range(parts))) for (i, _), c, k in zip(kept, cut, codes)), key=repr), books


@pytest.mark.parametrize("wide,block,entries,rounds", [(1, 2048, 16, 4), (1, 7, 16, 6), (1, 64, 1, 3), (1, 64, 256, 2), (1e5, 64, 8, 3), (1e18, 32, 4, 2)])
def test_codes_against_plain_rounds(spark, monkeypatch, wide, block, entries, rounds):
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    rng = random.Random(block)
    scale = 1024 if wide < 1e15 else 1
    rows = [(i * 7 % 199, [rng.choice([-1, 0, 0.25, 1]) + rng.gauss(0, 0.1) for _ in range(8)]) for i in range(199)]
    rows += [(300 + i, rows[i][1]) for i in range(20)] + [(5, rows[0][1]), (None, rows[3][1]), (400, None), (401, []), (402, [1.0] * 7 + [None]), (403, [float("nan")] * 8), (404, [float("inf")] + [0.0] * 7)]
    rows += [(500 + i, [wide * rng.random() for _ in range(8)]) for i in range(9)] if wide > 1 else []
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, code string")
    coded, books = vector_codes.encode(frame, label=None, scale=scale, entries=entries, rounds=rounds)
    want, plain = brute_codes(rows, scale, 4, entries, rounds)
    if wide == 1e18:  # errors beyond 63 bits are refused; the codebooks are exact all the same
        with pytest.raises(Exception, match="too large"):
            coded.collect()
    else:
        assert sorted(((r.id, r.code, r.error) for r in coded.collect()), key=repr) == want
    assert [[[int(x) for x in e] for e in b.tolist()] for b in books] == plain


def test_codes_of_empty_and_uneven_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    coded, books = vector_codes.encode(none)
    assert coded.count() == 0 and books == []
    rows = [(1, [1.0, 2.0, 3.0, 4.0], 1), (2, [1.0, 2.0], None)]
    with pytest.raises(ValueError, match="another length"):
        vector_codes.encode(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))


def test_only_what_drift_has_reached_is_popped():
    rng = np.random.default_rng(2)
    code, key = rng.integers(0, 9, 500), rng.random(500)
    drift = rng.random(9) * 0.6
    items = vector_codes.heaps(code, key)
    got = vector_codes.popped(items, code, key, drift)
    assert sorted(got.tolist()) == np.flatnonzero(key <= drift[code]).tolist()
    assert len(vector_codes.popped(items, code, key, np.zeros(9) - 1)) == 0
