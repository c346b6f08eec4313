"""Product codes of vectors, learned by Lloyd rounds that rescan only what may have changed: Heap Lloyd.

Components become integers, so all distances and sums are exact and reruns agree. A vector is cut into ``PARTS`` parts;
each part position has a codebook. Vectors lie in blocks of at most ``BLOCK``, one row each, which hold their parts, their
assignment and, for each part position, one heap for each entry over the parts assigned to it. A heap's key is a part's
slack, its lower bound (the distance to the second nearest entry) less its upper bound (the distance to its own), as it
was when the part was pushed, plus the entry's drift until then. In each round an entry's drift grows by its own move and
the largest move of another, by which slack shrinks at most; only parts whose key the drift has reached can have changed
and are popped, from the top of the heap down, rescanned exactly against the whole codebook, and pushed anew. Heaps are
arrays in level order; a round pops level by level, and what is pushed back is merged by one sort, as a sorted run is a
heap.

A round is one pass over the blocks. It writes them anew with what their moved parts add to and take from the entries'
sums; those are added up by entry, and only codebooks (entries times components, whatever the number of vectors) meet at
the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm._common import Scratch, table

SCALE, PARTS, ENTRIES, ROUNDS, BLOCK = 1024, 4, 256, 4, 2048
#: Entries of a codebook at most, as a code is two hexadecimal digits.
ENTRIES_MOST = 256
#: Bounds are square roots in doubles: a part is popped that much, in proportion, before its slack is used up.
MARGIN = 1e-9
_STATE = "ids array<long>, labels array<string>, codes binary, items binary, keys binary, vectors binary, dim int, wide boolean, at array<int>, delta array<string>, members array<long>"


def narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers as doubles where all sums of squares of differences are exact in them, else as Python's integers."""
    if x.size == 0 or 4 * x.shape[1] * float(np.abs(x).max()) ** 2 < 2.0**52:
        return x.astype(np.float64)
    return np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def whole_numbers(vectors: list, scale: int) -> np.ndarray:
    """floor(scale * x), see ``narrow``; beyond 2^53 doubles are whole numbers themselves."""
    x = np.array(vectors, np.float64).reshape(len(vectors), -1)
    if x.size and np.abs(x).max() * scale >= 2.0**53:
        return narrow(np.array([[int(v) * scale if abs(v) >= 2.0**53 else math.floor(v * scale) for v in row] for row in x.tolist()], object))
    return narrow(np.floor(x * scale))


def together(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as Python's integers if one is."""
    if object in (x.dtype, book.dtype):
        return tuple(v if v.dtype == object else v.astype(np.int64).astype(object) for v in (x, book))
    return x, book


def squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row to each entry."""
    x, book = together(x, book)
    if x.dtype == object:
        return np.stack([((x - entry) ** 2).sum(1) for entry in book], 1)
    return (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, ties to the lower index, and its slack."""
    code, slack = np.empty(len(x), np.int64), np.empty(len(x))
    for i in range(0, len(x), 4096):
        far = squared(x[i : i + 4096], book)
        own = far.argmin(1)
        rows = np.arange(len(far))
        least = np.sqrt(far[rows, own].astype(np.float64))
        if len(book) > 1:
            far[rows, own] = 2 * far.max() + 1
            second = np.sqrt(far.min(1).astype(np.float64))
        else:
            second = np.full(len(far), np.inf)
        code[i : i + 4096], slack[i : i + 4096] = own, second - least - MARGIN * (second + least if len(book) > 1 else 0)
    return code, slack


def heaps(code: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Items in heaps by entry, one after another: each is sorted by key, and so a heap in level order."""
    return np.lexsort((key, code))


def popped(items: np.ndarray, code: np.ndarray, key: np.ndarray, drift: np.ndarray) -> np.ndarray:
    """The items whose key their entry's drift has reached. Each heap is entered at its top; below an item that stays
    all items stay, so only violated items and their children are looked at."""
    own = code[items]
    entry = np.unique(own)
    start = np.searchsorted(own, entry)
    size = np.diff(np.concatenate([start, [len(items)]]))
    place, out = np.zeros(len(entry), np.int64), []
    while len(place):
        item = items[start + place]
        bad = key[item] <= drift[entry]
        out.append(item[bad])
        entry, start, size = (np.repeat(v[bad], 2) for v in (entry, start, size))
        place = np.repeat(2 * place[bad], 2) + np.tile([1, 2], bad.sum())
        inside = place < size
        place, entry, start, size = place[inside], entry[inside], start[inside], size[inside]
    return np.concatenate(out) if out else np.empty(0, np.int64)


def drifted(drift: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """``drift`` of the entries of one codebook after a round: each one's own move and the largest of any other."""
    move = np.array([float(np.sqrt(float(sum((int(a) - int(b)) ** 2 for a, b in zip(o, n))))) for o, n in zip(old.tolist(), new.tolist())]) * (1 + MARGIN)
    if len(move) < 2:
        return drift
    top = np.argsort(move)[-2:]
    other = np.where(np.arange(len(move)) == top[1], move[top[0]], move[top[1]])
    return drift + move + other


def moved(x: np.ndarray, took: np.ndarray, gave: np.ndarray) -> tuple[list[int], list[str], list[int]]:
    """What parts add to the entries they now belong to and take from the ones they left (-1: none): entry, its sums as
    text (they may exceed 64 bits), and members."""
    entries, sums, members = [], [], []
    for e in np.unique(np.concatenate([took, gave[gave >= 0]])).tolist():
        plus, minus = x[took == e], x[gave == e]
        total = [a - b for a, b in zip((plus.sum(0) if len(plus) else np.zeros(x.shape[1], x.dtype)).tolist(), (minus.sum(0) if len(minus) else np.zeros(x.shape[1], x.dtype)).tolist())]
        entries.append(e)
        sums.append(",".join(str(int(v)) for v in total))
        members.append(len(plus) - len(minus))
    return entries, sums, members


def _pack(x: np.ndarray) -> bytes:
    return x.astype(np.int32).tobytes() if x.dtype != object else ",".join(str(v) for v in x.ravel()).encode()


def _unpack(data: bytes, dim: int, wide: bool) -> np.ndarray:
    if wide:
        return np.array([int(v) for v in data.decode().split(",")], object).reshape(-1, dim)
    return np.frombuffer(data, np.int32).reshape(-1, dim).astype(np.float64)


def _cut(x: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(x, parts, axis=1)


def _assigned(books: list[np.ndarray], drifts: list[np.ndarray], x: np.ndarray, state: list[tuple] | None) -> tuple[list[tuple], tuple[list, list, list]]:
    """A round over one block: the state (code, key, heaps) of each part position, and what moved."""
    new, at, delta, members = [], [], [], []
    for p, own in enumerate(_cut(x, len(books))):
        if state is None:
            code, key = nearest(own, books[p])
            key = key + drifts[p][code]
            took, gave, moving = code, np.full(len(code), -1), own
        else:
            code, key, items = state[p]
            code, key = code.copy(), key.copy()
            out = popped(items, code, key, drifts[p])
            before = code[out]
            code[out], slack = nearest(own[out], books[p])
            key[out] = slack + drifts[p][code[out]]
            change = code[out] != before
            took, gave, moving = code[out][change], before[change], own[out][change]
        new.append((code, key, heaps(code, key)))
        e, s, m = moved(moving, took, gave)
        at, delta, members = at + [p * ENTRIES_MOST + v for v in e], delta + s, members + m
    return new, (at, delta, members)


def _row(ids, labels, x, state, change) -> tuple:
    code, key, items = (np.concatenate([s[i] for s in state]) for i in range(3))
    return (ids, labels, code.astype(np.uint8).tobytes(), items.astype(np.int32).tobytes(), key.astype(np.float64).tobytes(), _pack(x), x.shape[1], x.dtype == object, *change)


def _state(r, parts: int) -> list[tuple]:
    code, items, key = np.frombuffer(r.codes, np.uint8).astype(np.int64), np.frombuffer(r.items, np.int32).astype(np.int64), np.frombuffer(r.keys, np.float64)
    return list(zip(np.split(code, parts), np.split(key, parts), np.split(items, parts)))


_NAMES = [c.split()[0] for c in _STATE.split(", ")]


def _begin(books: list[np.ndarray], scale: int, dim: int):
    drifts = [np.zeros(len(b)) for b in books]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), BLOCK):
                part = batch.iloc[i : i + BLOCK]
                if any(len(v) != dim for v in part["v"]):
                    raise ValueError(f"vectors of other lengths than {dim}")
                x = whole_numbers(part["v"].tolist(), scale)
                state, change = _assigned(books, drifts, x, None)
                ids = [None if pd.isna(v) else int(v) for v in part["id"].tolist()]
                yield pd.DataFrame([_row(ids, part["label"].tolist(), x, state, change)], columns=_NAMES)

    return of


def _again(books: list[np.ndarray], drifts: list[np.ndarray]):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                x = _unpack(r.vectors, r.dim, r.wide)
                state, change = _assigned(books, drifts, x, _state(r, len(books)))
                yield pd.DataFrame([_row(r.ids, r.labels, x, state, change)], columns=_NAMES)

    return of


def _coded(books: list[np.ndarray]):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                codes = np.frombuffer(r.codes, np.uint8).reshape(len(books), -1)
                error = 0
                for own, code, book in zip(_cut(_unpack(r.vectors, r.dim, r.wide), len(books)), codes, books):
                    own, book = together(own, book)
                    error = error + ((own - book[code]) ** 2).sum(1)
                hexed = codes.T.tobytes().hex()
                out = pd.DataFrame({"id": pd.array(r.ids, "Int64"), "label": r.labels, "code": [hexed[i : i + 2 * len(books)] for i in range(0, len(hexed), 2 * len(books))]})
                out["error"] = [int(e) for e in error]
                yield out

    return of


def encode(vectors: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", label: str | None = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, label, code, error) of each kept vector, and the final codebooks, one array of entries for each part.

    Rows whose vector is null, empty, or holds null or non-finite components are left out. Codebooks start as the parts
    of the ``entries`` kept vectors of least id (nulls last, ties by the vector); with fewer vectors they are smaller.
    Rows that repeat an id or a vector count each. An empty table gives no rows and no codebooks; vectors of different
    lengths, or a length that ``parts`` does not divide, raise ValueError. ``error`` must fit 63 bits. Other columns are
    ignored. ``label`` is handed on as text.
    """
    if not 0 < entries <= ENTRIES_MOST:
        raise ValueError(f"1 to {ENTRIES_MOST} entries")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "codes")
    v = F.col(f"`{vector}`").cast("array<double>")
    own = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), (F.col(f"`{label}`").cast("string") if label else F.lit(None).cast("string")).alias("label"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = own.where(F.col("v").isNotNull() & (F.size("v") > 0) & fine)
    first = kept.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return kept.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0), []
    dim = len(first[0]["v"])
    if dim % parts or any(len(r["v"]) != dim for r in first):
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts, or others have another length")
    books = _cut(whole_numbers([r["v"] for r in first], scale), parts)
    drifts = [np.zeros(len(b)) for b in books]
    sums = [[[0] * (dim // parts) for _ in b] for b in books]
    counts = [[0] * len(b) for b in books]
    blocks = scratch.write(kept.mapInPandas(_begin(books, scale, dim), _STATE), "round0")
    for k in range(rounds):
        each = blocks.select(F.explode(F.arrays_zip("at", "delta", "members")).alias("x")).select("x.*")
        n = each.groupBy("at").agg(F.sum("members").alias("n"))
        part = each.select("at", F.posexplode(F.split("delta", ",")).alias("i", "d")).groupBy("at", "i").agg(F.sum(F.col("d").cast("decimal(38,0)")).alias("d"))
        for r in n.collect():  # a row for each entry
            counts[r["at"] // ENTRIES_MOST][r["at"] % ENTRIES_MOST] += r["n"]
        for r in part.collect():  # a row for each component of each entry
            sums[r["at"] // ENTRIES_MOST][r["at"] % ENTRIES_MOST][r["i"]] += int(r["d"])
        new = [narrow(np.array([[s // c for s in own] if c else list(map(int, o)) for own, c, o in zip(sums[p], counts[p], books[p].tolist())], object)) for p in range(parts)]
        drifts = [drifted(d, o, b) for d, o, b in zip(drifts, books, new)]
        books = new
        blocks = scratch.write(blocks.mapInPandas(_again(books, drifts), _STATE), f"round{k + 1}")
        scratch.drop(f"round{k}")
    return blocks.select("ids", "labels", "codes", "vectors", "dim", "wide").mapInPandas(_coded(books), "id long, label string, code string, error long"), books


def digest(books: list[np.ndarray]) -> str:
    """sha256 of all entries' components, by part, entry and position."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for e in b.tolist() for x in e).encode()).hexdigest()


def op13_heap_lloyd_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = encode(table(spark, sf_dir, "embeddings"))
    coded = Scratch(spark, "coded").write(coded, "rows")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _round_sql(k: int) -> str:
    """Assigns all parts to the codebooks b{k} and makes b{k + 1}."""
    return f"""
a{k} AS (SELECT x.vec_id, x.p, arg_min(b.e, [x.n - 2 * list_inner_product(x.v, b.v) + b.n, b.e]) AS e, min(x.n - 2 * list_inner_product(x.v, b.v) + b.n) AS far FROM x JOIN b{k} b USING (p) GROUP BY x.vec_id, x.p),
m{k} AS (SELECT a.p, a.e, i, floor(sum(x.v[i]) / count(*)) AS c FROM a{k} a JOIN x USING (vec_id, p), unnest(range(1, len(x.v) + 1)) AS u(i) GROUP BY a.p, a.e, i),
w{k} AS (SELECT p, e, list(c ORDER BY i) AS v FROM m{k} GROUP BY p, e),
b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(w.v, b.v) AS v, list_inner_product(coalesce(w.v, b.v), coalesce(w.v, b.v)) AS n FROM b{k} b LEFT JOIN w{k} w ON b.p = w.p AND b.e = w.e)"""


OP13_SQL = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
x AS MATERIALIZED (SELECT vec_id, p, v, list_inner_product(v, v) AS n FROM (SELECT vec_id, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS v FROM kept, range(4) AS r(p))),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256)),
b0 AS MATERIALIZED (SELECT p, e, v, n FROM x JOIN seeds USING (vec_id)),{",".join(_round_sql(k) for k in range(ROUNDS))},
a AS (SELECT x.vec_id, x.p, arg_min(b.e, [x.n - 2 * list_inner_product(x.v, b.v) + b.n, b.e]) AS e, min(x.n - 2 * list_inner_product(x.v, b.v) + b.n) AS far FROM x JOIN b{ROUNDS} b USING (p) GROUP BY x.vec_id, x.p),
o AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM a GROUP BY vec_id),
s AS (SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS h FROM b{ROUNDS} b, unnest(v) WITH ORDINALITY AS u(c, i))
SELECT o.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM o JOIN kept USING (vec_id), s
"""
