"""Near duplicates by min-max hashing.

A document's set holds the hashes of its distinct word shingles. Under each of ``BANDS * 4`` permutations both the
minimum and the maximum are kept, so a signature costs half the hash evaluations of one of minima alone. A band is
four permutations' minima and maxima; documents that agree in a band share a bucket. At likeness 0.8 two documents
share none with a probability below 1e-6 (1e-5 for sets of four and five shingles). Documents with equal sets are
merged before.

Links are confirmed on whole sets. A bit of each of 640 signature values makes a sketch; pairs whose sketches agree in
fewer bits than a likeness of 0.8 gives at six standard deviations are not compared. In a bucket members are first
compared with one member (a star), the one that shares most buckets with others and so is nearest to the group's
common text, and only across components found so far; so a group of n near copies costs about n
comparisons. What stars leave open is compared in full, but only across components: in small buckets by a join, in
large ones by blocks of at most ``ROWS`` rows of the bucket's largest component against as many of the others, so no
task holds a bucket and no pair is emitted that is not a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm._common import WORD, Scratch, apart, parts, released, table
from corvane.llm.bpe import Memo

BANDS, WIDTH, PERCENT, SEED = 84, 8, 80, 20240607
#: Stars are drawn again while they closed a third of the open pairs and more than this many times the bucket rows are
#: open, ``STARS`` times at most; each compares a document with at most ``CENTRES`` others.
OPEN, STARS, CENTRES = 2, 8, 8
#: Bits of a sketch, and the least that agree: 0.9 * 640 less six standard deviations.
BITS, AGREE = 640, 530
#: In buckets up to this size all open pairs are joined; in larger ones they are compared in blocks of rows.
SMALL, ROWS = 64, 1000
#: Links up to this number are joined by one task; more by rounds of joins, with equal results.
ONE_TASK = 1_000_000
#: Ids or buckets that may be broadcast to find copies, the texts of candidates and buckets' rows; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
_NONE = np.empty(0, np.int64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def multipliers(bands: int = BANDS, width: int = WIDTH) -> np.ndarray:
    """Odd numbers: multiplication by each permutes the 64-bit numbers."""
    return np.random.default_rng(SEED).integers(0, 2**63, bands * width // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Shingles:
    """Sorted hashes of the distinct shingles of ``k`` words of a text; of fewer words, of the whole sequence."""

    def __init__(self, k: int):
        self.k = k
        self.words = Memo(xxhash.xxh3_64_intdigest, 150_000)

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode().lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        k = min(self.k, len(h))
        out = np.full(len(h) - k + 1, np.uint64(k))
        for i in range(k):
            out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
        return np.unique(out)


def min_max(hashes: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Minimum and maximum under each permutation, interleaved."""
    out = np.empty((len(by), 2), np.uint64)
    step = max(1, 100_000 // len(hashes))
    for i in range(0, len(by), step):
        values = by[i : i + step, None] * hashes
        out[i : i + step, 0], out[i : i + step, 1] = values.min(1), values.max(1)
    return out.ravel()


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = signature.reshape(bands, -1)
    key = np.arange(bands, dtype=np.uint64) + np.uint64(1)
    for i in range(rows.shape[1]):
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return key.view(np.int64)


def sketch(signature: np.ndarray) -> np.ndarray:
    """A bit of each of the first ``BITS`` values, as 64-bit numbers."""
    return np.packbits(_mixed(signature[:BITS]) & np.uint64(1) == 1).view(np.int64)


def _signatures(k: int):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, by = Shingles(k), multipliers()
        for batch in released(batches):
            for i in range(0, len(batch), 1000):
                part = batch.iloc[i : i + 1000]
                sets = [shingles(t) for t in part["text"]]
                signed = [min_max(s, by) if len(s) else None for s in sets]
                yield pd.DataFrame({
                    "doc": part["doc"].array, "n": [len(s) for s in sets], "same": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                    "bands": [_NONE if x is None else band_keys(x) for x in signed], "bits": [_NONE if x is None else sketch(x) for x in signed],
                })

    return of


def _sets(k: int):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingles(k)
        for batch in released(batches):
            for i in range(0, len(batch), 500):
                part = batch.iloc[i : i + 500]
                yield pd.DataFrame({"doc": part["doc"].array, "set": [shingles(t).view(np.int64) for t in part["text"]]})

    return of


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find; the least id of a set is its root."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (y := up.setdefault(top, top)) != top:
            top = y
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    docs = list(up)
    yield pd.DataFrame({"doc": docs, "component": [root(d) for d in docs]}, dtype="int64")


def components(edges: DataFrame, scratch: Scratch, name: str, one_task: int = ONE_TASK) -> DataFrame:
    """``doc`` and ``component`` (the least id reachable) of the ends of ``edges`` (a, b; written, cheap to read).

    Up to ``one_task`` edges one task joins them. More take rounds, each the least label of the neighbours, then the
    label of the label, until none changes.
    """
    if edges.count() <= one_task:
        return scratch.write(edges.coalesce(1).mapInPandas(_joined, "doc long, component long"), f"{name}-1")
    both = scratch.write(edges.select(F.col("a").alias("doc"), F.col("b").alias("near")).union(edges.select("b", "a")), f"{name}-links")
    own = both.groupBy("doc").agg(F.min("near").alias("m")).select("doc", F.least("doc", "m").alias("component"))
    own = scratch.write(own, f"{name}-0")
    total, k = own.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0], 0
    while True:
        near = own.select(F.col("doc").alias("near"), F.col("component").alias("c"))
        heard = both.join(near, "near").groupBy("doc").agg(F.min("c").alias("m"))
        new = own.join(heard, "doc").select("doc", F.least("component", "m").alias("component"))
        jump = new.select(F.col("doc").alias("component"), F.col("component").alias("c"))
        new = scratch.write(new.join(jump, "component").select("doc", F.col("c").alias("component")), f"{name}-{k + 1}")
        scratch.drop(f"{name}-{k}")
        before, total = total, new.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        own, k = new, k + 1
        if total == before:
            scratch.drop(f"{name}-links")
            return own


def _agreeing(bits: np.ndarray, all_bits: np.ndarray) -> np.ndarray:
    """Bits of a sketch that agree with each of others."""
    return BITS - np.bitwise_count(bits ^ all_bits).sum(1, dtype=np.int64)


def links_of_block(block: pd.DataFrame) -> pd.DataFrame:
    """Links between the rows of two sides of a bucket (``other`` and not), or within ``other`` if ``within``.

    A row is compared with the likeliest rows first and, once linked to a component, no more with that component.
    """
    words = [f"s{i}" for i in range(BITS // 64)]
    doc, n, part = (block[c].to_numpy() for c in ("doc", "n", "component"))
    bits, sets, other = block[words].to_numpy(np.int64).view(np.uint64), block["set"].to_numpy(), block["other"].to_numpy(bool)
    within = bool(block["within"].iloc[0])
    right = np.flatnonzero(other if within else ~other)
    out = []
    for i in np.flatnonzero(other).tolist():
        agree = _agreeing(bits[i], bits[right])
        fine = (agree >= AGREE) & (part[right] != part[i]) & (100 * np.minimum(n[right], n[i]) >= PERCENT * np.maximum(n[right], n[i]))
        if within:
            fine &= doc[right] > doc[i]
        likely, linked = right[fine][np.argsort(-agree[fine], kind="stable")], set()
        for j in likely.tolist():
            if part[j] in linked:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= PERCENT * (n[i] + n[j] - both):
                linked.add(part[j])
                out.append((min(doc[i], doc[j]), max(doc[i], doc[j])))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def large_bucket_links(rows: DataFrame, sets: DataFrame, size: int = ROWS) -> DataFrame:
    """All links across components that stars left in buckets. ``rows``: key, doc, n, component, sketch, and of the key
    ``main`` (its largest component), ``k`` (that one's rows) and ``m`` (all rows).

    Rows of the main component and the others get blocks by a hash; every pair of blocks that must meet is a group.
    """
    rows = rows.withColumn("other", F.col("component") != F.col("main"))
    mains, others = (F.greatest(F.lit(1), F.ceil(x / size)).cast("int") for x in (F.col("k"), F.col("m") - F.col("k")))
    own = F.pmod(F.xxhash64("doc"), F.when(F.col("other"), others).otherwise(mains).cast("long")).cast("int")
    meets = lambda within, i, j: F.struct(F.lit(within).alias("within"), i.alias("i"), j.alias("j"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    of_main = F.transform(upto(others), lambda o: meets(False, F.col("own"), o))
    of_other = F.concat(
        F.transform(upto(mains), lambda o: meets(False, o, F.col("own"))),
        F.transform(upto(others), lambda o: meets(True, F.least(o, F.col("own")), F.greatest(o, F.col("own")))),
    )
    placed = rows.withColumn("own", own).withColumn("at", F.explode(F.when(F.col("other"), of_other).otherwise(of_main)))
    placed = placed.select("key", "at.*", "doc", "n", "component", "other", *[f"s{i}" for i in range(BITS // 64)]).join(sets, "doc")
    return placed.groupBy("key", "within", "i", "j").applyInPandas(links_of_block, "a long, b long").distinct()


class _Linker:
    """Confirms pairs on whole sets and keeps what was confirmed and compared so far."""

    def __init__(self, scratch: Scratch, sets: DataFrame):
        self.scratch, self.sets, self.round = scratch, sets, 0
        self.compared: DataFrame | None = None
        self.labels: DataFrame | None = None

    def labelled(self, buckets: DataFrame) -> DataFrame:
        if self.labels is None:
            return buckets.withColumn("component", F.col("doc"))
        own = buckets.join(self.labels.withColumnRenamed("component", "c"), "doc", "left")
        return own.withColumn("component", F.coalesce("c", "doc")).drop("c")

    def confirm(self, pairs: DataFrame) -> None:
        """``pairs`` (a < b, distinct): compares those not compared yet, and labels components anew."""
        self.round += 1
        if self.compared is not None:
            pairs = pairs.join(self.compared, ["a", "b"], "left_anti")
        pairs = self.scratch.write(pairs, f"pairs{self.round}")
        self.compared = pairs if self.compared is None else self.compared.union(pairs)
        a = self.sets.select(F.col("doc").alias("a"), F.col("set").alias("x"))
        b = self.sets.select(F.col("doc").alias("b"), F.col("set").alias("y"))
        common = F.size(F.array_intersect("x", "y"))
        found = pairs.join(a, "a").join(b, "b").select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"), common.alias("both"))
        found = self.scratch.write(found.where(100 * F.col("both") >= PERCENT * (F.col("n") + F.col("m") - F.col("both"))).select("a", "b"), f"links{self.round}")
        self.take(found)

    def take(self, found: DataFrame) -> None:
        """Labels components anew with these links."""
        if self.labels is not None:  # what is joined already counts as one link for each document
            found = found.union(self.labels.select("doc", "component").where("doc <> component"))
        self.labels = components(self.scratch.write(found, f"all{self.round}"), self.scratch, f"labels{self.round}")


def _few(ids: DataFrame) -> DataFrame:
    """Ids or buckets to join with, a row each; broadcast if their number allows, else a hot one's rows are split as a skewed join."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (least id linked, itself included) and kept (doc_id = component_id) per row.

    Documents are linked at a Jaccard likeness of 0.8 or more of their sets of ``shingle`` words; equal sets are one
    class from the start. Null, empty and white texts have empty sets and link with nothing. Rows that repeat an id
    are one document, and each is returned; rows without id link with nothing but equal sets, and take the class's
    component. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    signed = scratch.write(own.mapInPandas(_signatures(shingle), "doc long, n long, same binary, bands array<long>, bits array<long>"), "signatures")
    slim = signed.select("doc", "n", "same")
    classes = scratch.write(slim.where("n > 0").groupBy("same").agg(F.min("doc").alias("first")), "classes")
    # the ids of copies are slimmer to send than the signatures of all others
    copies = slim.where("n > 0").select("doc").distinct().join(classes.select(F.col("first").alias("doc")), "doc", "left_anti")
    banded = signed.where("n > 0 AND doc IS NOT NULL").join(_few(scratch.write(copies.where("doc IS NOT NULL"), "copies")), "doc", "left_anti")
    rows = banded.select("doc", "n", F.explode("bands").alias("key"))
    sizes = rows.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("size"))
    shared = scratch.write(sizes.where("low < high").select("key", "size"), "shared")  # summed up before the shuffle: no task gets a bucket
    buckets = scratch.write(rows.join(_few(shared), "key"), "rows")
    ids = scratch.write(buckets.select("doc").distinct(), "candidates")
    few = _few(ids)
    sets = scratch.write(own.join(few, "doc", "left_semi").mapInPandas(_sets(shingle), "doc long, set array<long>"), "sets")
    bits = [f"s{i}" for i in range(BITS // 64)]
    sketches = signed.select("doc", "same", *[F.col("bits")[i].alias(c) for i, c in enumerate(bits)]).join(few, "doc", "left_semi")
    sketches = sketches.groupBy("doc").agg(*[F.min_by(c, "same").alias(c) for c in bits])
    sketches = scratch.write(sketches, "sketches")  # bucket rows stay slim; pairs get the sketches of their two documents
    hubs = buckets.groupBy("doc").agg(F.sum("size").alias("hub"))
    buckets = scratch.write(buckets.drop("size").join(hubs, "doc"), "buckets")
    linker = _Linker(scratch, sets)
    agree = BITS - sum(F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_"))) for c in bits)
    fits = (100 * F.least("n", "n_") >= PERCENT * F.greatest("n", "n_")) & (F.col("component") != F.col("component_"))
    others = sketches.toDF("doc_", *[f"{c}_" for c in bits])
    limit, last = OPEN * buckets.count(), None
    for turn in range(STARS + 1):
        labelled = linker.labelled(buckets)
        if turn:
            sizes = labelled.groupBy("key", "component").agg(F.count("*").alias("k")).groupBy("key").agg(
                F.sum("k").alias("m"), F.sum(F.col("k") * F.col("k")).alias("s"), F.count("*").alias("parts"),
                F.max("k").alias("k"), F.max_by("component", F.struct("k", "component")).alias("main"),
            ).where("parts > 1")
            # a row's share of its bucket's open pairs
            sizes = scratch.write(sizes.select("key", "m", "k", "main", ((F.col("m") - F.col("s") / F.col("m")) / 2).alias("open")), f"sizes{turn}")
            each = sizes.agg(F.sum(F.col("m") * F.col("open"))).first()[0]
            if not each:
                break
            labelled = scratch.write(labelled.join(_few(sizes), "key"), f"open{turn}")
            buckets = labelled.select("key", "doc", "n", "hub")
            done = turn == STARS or each <= limit or (last is not None and each > last * 2 / 3)
            last = each
            if done:
                small = labelled.where(F.col("m") <= SMALL)
                members = small.groupBy("key", "m").agg(*[F.bit_xor(F.xxhash64("doc", F.lit(i))).alias(f"x{i}") for i in range(2)])
                one = members.groupBy("m", "x0", "x1").agg(F.min("key").alias("key")).select("key")  # of buckets of the same documents
                small = small.join(one, "key", "left_semi").join(sketches, "doc")
                other = small.select("key", *[F.col(c).alias(f"{c}_") for c in ("doc", "n", "component", *bits)])
                pairs = small.join(other, "key").where((F.col("doc") < F.col("doc_")) & fits & (agree >= AGREE))
                linker.confirm(pairs.select(F.col("doc").alias("a"), F.col("doc_").alias("b")).distinct())
                linker.round += 1
                linker.take(scratch.write(large_bucket_links(labelled.where(F.col("m") > SMALL).join(sketches, "doc"), sets), f"links{linker.round}"))
                break
        # the best hub; in later turns any, by a hash
        h = F.struct("hub", "doc") if turn == 0 else F.xxhash64("doc", F.lit(turn))
        centre = labelled.groupBy("key").agg(*[F.max_by(c, h).alias(f"{c}_") for c in ("doc", "n", "component", "hub")])
        pairs = labelled.join(centre, "key").where(fits).select("doc", "doc_", "hub_").distinct()
        pairs = pairs.join(sketches, "doc").join(others, "doc_").where(agree >= AGREE).select("doc", "doc_", "hub_")
        first = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("hub_"), "doc_"))
        pairs = pairs.withColumn("k", first).where(F.col("k") <= CENTRES)  # the others stay open
        linker.confirm(pairs.select(F.least("doc", "doc_").alias("a"), F.greatest("doc", "doc_").alias("b")).distinct())
    scratch.drop("copies", "shared", "rows", "candidates", "sets", "sketches", "buckets", *[f"{x}{i}" for x in ("sizes", "open") for i in range(1, STARS + 1)])
    scratch.drop(*[f"{x}{i}" for x in ("pairs", "links", "all") for i in range(1, linker.round + 1)])
    out = slim.join(classes, "same", "left")
    labels = linker.labels
    if labels is None:
        out = out.withColumn("component", F.lit(None).cast("long"))
    else:
        out = out.join(labels.withColumnRenamed("doc", "first"), "first", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "first", "doc")).otherwise(F.col("doc"))
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", shingle: int = 5, repeats: bool = True) -> DataFrame:
    """One document of each group of near duplicates, the one of the least id, with its columns unchanged.

    Rows without id are known by a hash of their text, one row for each text, and come after all ids below 2^62.
    ``repeats``: rows that repeat an id and its text all stay, else one of them. Texts without words all stay.
    """
    d, back, (i, t) = apart(docs, id_col, text)
    whole = F.col(t).cast("string")
    words = F.coalesce(whole.rlike(WORD), F.lit(False))
    by_text = F.xxhash64(whole).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    keyed = d.withColumn("key", F.coalesce(F.col(i).cast("long"), by_text))
    gone = near_duplicates(keyed, id_col="key", text=t, shingle=shingle).where("NOT kept").select(F.col("doc_id").alias("gone")).distinct()
    left = keyed.join(gone, F.col("key") == F.col("gone"), "left_anti")
    copy = words & F.col(i).isNull() if repeats else words
    many = keyed.where(copy).groupBy("key").count().where("count > 1").select("key")
    many = Scratch(docs.sparkSession, "repeats").write(many, "keys")
    if many.isEmpty():
        return left.select(*back)
    rest = left.join(many, "key", "left_anti")
    again = left.join(many, "key", "left_semi")
    first = F.row_number().over(Window.partitionBy("key", t).orderBy(F.to_json(F.struct(*[F.col(c) for c in d.columns]))))
    once = again.where(copy).withColumn("row", first).where("row = 1").drop("row")
    return rest.unionByName(again.where(~copy)).unionByName(once).select(*back)


def op2_min_max_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=2)


OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s FROM w),
sized AS (SELECT doc_id, s, len(s) AS n, min(doc_id) OVER (PARTITION BY s) AS rep FROM s),
reps AS (SELECT rep, n, s FROM sized WHERE doc_id = rep AND n > 0),
x AS (SELECT rep, n, unnest(s) AS g FROM reps),
links AS (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
          GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT rep AS a, rep AS b FROM reps UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
c AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a)
SELECT z.doc_id, z.n::BIGINT AS n_shingles, CASE WHEN z.n = 0 THEN z.doc_id ELSE c.component_id END AS component_id,
       z.doc_id = CASE WHEN z.n = 0 THEN z.doc_id ELSE c.component_id END AS kept
FROM sized z LEFT JOIN c ON z.rep = c.rep
"""
