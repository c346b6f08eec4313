"""Near duplicates by SimHash, linked through BK-trees.

A text's fingerprint has a bit set where more than half of its shingles' 64-bit hashes have it. Documents of equal
fingerprints are one class from the start. Distinct fingerprints link at ``RADIUS`` or fewer differing bits.

Fingerprints are cut into blocks of bits. Two that differ in r bits or fewer agree in all blocks but r, so for every
choice of all but r blocks a fingerprint has a key, and linked ones share a key. Shards hold whole keys, and shards
beyond ``TREE`` entries are split by a hash of the fingerprint. Each part of a shard is a forest with one BK-tree for
each key: a child hangs at its Hamming distance to the parent, at most one at each distance, so of a node at distance d
from a query only the children at d - r to d + r can hold what lies within r. A tree is four arrays in order of levels:
fingerprints, the first child, and a 64-bit mask of the children's distances, with the roots' keys; whole batches of
queries descend at once.

A part is searched by its own fingerprints where it is built. The trees of split shards are then sent to the blocks of
queries of the other parts: broadcast if all of them together have at most ``BROADCAST`` entries, else by a shuffle on the
shard, since the trees of all documents have no bound. No task gets more than a block and a tree, and a search emits
links between components only, never all pairs of a group.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm._common import Scratch, few, parts, table, text_col
from corvane.llm.near_dedup import components

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints of a key on average, beyond which keys take more bits; entries of a tree; queries that descend at once;
#: entries of all trees that are broadcast at most (of 28 bytes).
SHARED, TREE, AT_ONCE, BROADCAST = 256, 2000, 256, 1_000_000
_PLANTED = "shard long, part int, n int, keys binary, fps binary, first binary, mask binary, own binary, comp binary, a array<long>, b array<long>"
_ONE = np.uint64(1)


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """64 bits, as a signed number; 0 for a text without words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    k = min(k, len(words))
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - k + 1
    over = np.zeros(64, np.int64)
    for i in range(0, n, 50_000):
        j = min(n, i + 50_000)
        h = np.fromiter([xxhash.xxh64_intdigest(line[s:e], SEED) for s, e in zip(starts[i:j].tolist(), ends[i + k - 1 : j + k - 1].tolist())], np.uint64, j - i)
        over += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * over > n, bitorder="little").view(np.int64)[0])


def with_fingerprint(docs: DataFrame, *, text: str = "text", shingle: int = SHINGLE, into: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each whole text as a signed number; 0 for null and texts without words."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return docs.withColumn(into, of(text_col(f"`{text}`")))


def key_masks(n: int, radius: int = RADIUS) -> list[int]:
    """Bit masks, signed, of which two fingerprints within ``radius`` agree in one at least: the fewest blocks with which
    ``n`` random fingerprints share a key with ``SHARED`` others or fewer."""
    blocks = next((b for b in range(radius + 1, 33) if n <= SHARED * 2 ** (64 * (b - radius) / b)), 32)
    cut = [round(64 * i / blocks) for i in range(blocks + 1)]
    bits = [(1 << cut[i + 1]) - (1 << cut[i]) for i in range(blocks)]
    masks = [sum(c) for c in itertools.combinations(bits, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def plant(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, ...]:
    """A forest of BK-trees, one for each key: the roots' keys, then for each node, level by level, its fingerprint, its
    first child, the mask of its children's distances (bit d - 1 for d) and its key.

    At each level the entries that reach a node at equal distance hang below the first of them."""
    order = np.lexsort((fp, key))
    key, fp = key[order], fp[order]
    at = np.arange(len(fp))  # entries that are not placed yet
    group = np.unique(key, return_inverse=True)[1]
    roots, levels, firsts, masks, base = None, [], [], [], 0
    while len(at):
        node = np.concatenate([[True], group[1:] != group[:-1]])
        which = np.cumsum(node) - 1  # of the entries, sorted by group: the node they reach
        placed = at[node]
        if roots is None:
            roots = key[placed]
        rest, parent = at[~node], which[~node]
        far = np.bitwise_count(fp[rest] ^ fp[placed][parent]).astype(np.int64)
        down = np.lexsort((rest, far, parent))
        at, parent, far = rest[down], parent[down], far[down]
        group = parent * 65 + far
        child = np.unique(group)
        mask, first = np.zeros(len(placed), np.uint64), np.zeros(len(placed), np.int32)
        np.bitwise_or.at(mask, child // 65, _ONE << (child % 65 - 1).astype(np.uint64))
        base += len(placed)
        first[:] = base + np.searchsorted(child, np.arange(len(placed)) * 65)
        levels, firsts, masks = [*levels, placed], [*firsts, first], [*masks, mask]
    nodes = np.concatenate(levels)
    return roots, fp[nodes], np.concatenate(firsts), np.concatenate(masks), key[nodes]


def search(tree: tuple[np.ndarray, ...], fp: np.ndarray, key: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Queries and nodes within ``radius`` of each other, level by level; only edges within the radius are followed."""
    roots, fps, first, mask = tree[:4]
    near = np.array([sum(1 << (x - 1) for x in range(max(1, d - radius), min(64, d + radius) + 1)) for d in range(65)], np.uint64)
    below = np.array([(1 << max(0, min(64, d - radius - 1))) - 1 for d in range(65)], np.uint64)
    for i in range(0, len(fp), AT_ONCE):
        root = np.searchsorted(roots, key[i : i + AT_ONCE])
        have = np.flatnonzero(roots[np.minimum(root, len(roots) - 1)] == key[i : i + AT_ONCE])
        query, node = i + have, root[have]
        while len(query):
            far = np.bitwise_count(fp[query] ^ fps[node])
            hit = far <= radius
            if hit.any():
                yield query[hit], node[hit]
            own = mask[node]
            edges = np.bitwise_count(own & near[far]).astype(np.int64)
            start = first[node] + np.bitwise_count(own & below[far])
            query = np.repeat(query, edges)
            node = np.repeat(start - (np.cumsum(edges) - edges), edges) + np.arange(len(query))


def spanning(found: Iterator[tuple[np.ndarray, np.ndarray]], comp: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Of the pairs found, those that join two components; and the components after them. ``comp``: the label of each
    member, the number of one of them."""
    links = []
    up = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    for a, b in found:
        x, y = comp[a], comp[b]
        apart = np.flatnonzero(x != y)
        if not len(apart):
            continue
        each = np.unique(np.minimum(x, y)[apart] * len(comp) + np.maximum(x, y)[apart], return_index=True)[1]
        for i in apart[each].tolist():
            p, q = root(int(x[i])), root(int(y[i]))
            if p != q:
                up[max(p, q)] = min(p, q)
                links.append((int(a[i]), int(b[i])))
        labels = np.unique(comp)
        roots = np.array([root(int(c)) for c in labels])
        comp = roots[np.searchsorted(labels, comp)]
    return links, comp


def _plant(radius: int):
    def of(rows: pd.DataFrame) -> pd.DataFrame:
        tree = plant(rows["key"].to_numpy("int64"), rows["fp"].to_numpy("int64").view(np.uint64))
        fps = tree[1]
        links, comp = spanning(search(tree, fps, tree[4], radius), np.arange(len(fps)))
        a, b = (np.array([pair[i] for pair in links], np.int64) for i in (0, 1))
        signed = fps.view(np.int64)
        packed = [x.tobytes() for x in (tree[0], fps, tree[2], tree[3], tree[4], comp.astype(np.int32))]
        return pd.DataFrame([(rows["shard"].iloc[0], rows["part"].iloc[0], len(fps), *packed, signed[a].tolist(), signed[b].tolist())], columns=[c.split()[0] for c in _PLANTED.split(", ")])

    return of


def _across(radius: int):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows: a block of queries (q_fps, q_own, q_comp) and a tree of another part of its shard."""
        for batch in batches:
            for r in batch.itertuples(index=False):
                fps, keys, comp = np.frombuffer(r.q_fps, np.uint64), np.frombuffer(r.q_own, np.int64), np.frombuffer(r.q_comp, np.int32).astype(np.int64)
                tree = (np.frombuffer(r.keys, np.int64), np.frombuffer(r.fps, np.uint64), np.frombuffer(r.first, np.int32), np.frombuffer(r.mask, np.uint64))
                both = np.concatenate([comp, len(fps) + np.frombuffer(r.comp, np.int32).astype(np.int64)])
                links, _ = spanning(((q, len(fps) + n) for q, n in search(tree, fps, keys, radius)), both)
                every = np.concatenate([fps, tree[1]]).view(np.int64)
                yield pd.DataFrame({"a": [every[a] for a, _ in links], "b": [every[b] for _, b in links]}, dtype="int64")

    return of


def links(prints: DataFrame, scratch: Scratch, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints within ``radius`` that join all that is linked; ``prints``: distinct ``fp``,
    written."""
    spark = prints.sparkSession
    masks = key_masks(n := prints.count(), radius)
    shards = max(1, -(-n * len(masks) // TREE))
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])
    entries = prints.select("fp", F.explode(keys).alias("key")).withColumn("shard", F.pmod("key", F.lit(shards)))
    sizes = scratch.write(entries.groupBy("shard").agg(F.ceil(F.count("*") / TREE).cast("int").alias("parts")).where("parts > 1"), "split")
    entries = entries.join(few(sizes.count(), sizes), "shard", "left").withColumn("part", F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int"))
    trees = scratch.write(entries.select("shard", "part", "key", "fp").groupBy("shard", "part").applyInPandas(_plant(radius), _PLANTED), "trees")
    within = trees.select(F.explode(F.arrays_zip("a", "b")).alias("x")).select("x.a", "x.b")
    split = trees.drop("a", "b").join(few(sizes.count(), sizes), "shard", "left_semi")
    total = split.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        return within
    queries = split.where("part > 0").select("shard", F.explode(F.sequence(F.lit(0), F.col("part") - 1)).alias("part"), F.col("part").alias("block"), *[F.col(c).alias(f"q_{c}") for c in ("fps", "own", "comp")])
    queries = queries.repartition(parts(spark), "shard", "part", "block")
    sent = split.select("shard", "part", "keys", "fps", "first", "mask", "comp")
    met = queries.join(F.broadcast(sent) if total <= BROADCAST else sent, ["shard", "part"])
    return within.unionByName(met.drop("shard", "part", "block").mapInPandas(_across(radius), "a long, b long"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hexadecimal digits) and component_id, the least id linked, for each row.

    Texts are read whole. Null, empty and white texts have fingerprint zero and link like any other. Rows that repeat
    an id are each returned and linked by each of their texts; rows without id take their component's least id, null
    if no row of it has one. An empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    signed = scratch.write(with_fingerprint(own, shingle=shingle, into="fp").drop("text"), "prints")
    classes = scratch.write(signed.groupBy("fp").agg(F.min("doc").alias("least")), "classes")
    # one document may have several fingerprints if its id repeats: they are joined by the id
    many = signed.where("doc IS NOT NULL").groupBy("doc").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").select("doc", "a")
    many = scratch.write(many, "repeats")
    same = signed.join(few(many.count(), many), "doc").select("a", F.col("fp").alias("b")).where("a <> b")
    edges = links(classes.select("fp"), scratch, radius)
    edges = scratch.write(edges.unionByName(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = components(edges, scratch, "labels").toDF("fp", "label")
    labelled = classes.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    whole = scratch.write(labelled.join(least, "label").select("fp", "component_id"), "components")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return signed.join(whole, "fp").select(F.col("doc").alias("doc_id"), hexed.alias("fingerprint"), "component_id")


def op12_bk_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
