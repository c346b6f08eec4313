"""Token ids in files: canonical length-limited Huffman codes, blocks of documents, bit-offset checkpoints.

Layout of a folder:

- ``codebook``: a row (id, length) for each id that occurs. Codes are canonical: in order of length, then id.
- ``blocks``: a row for each block of whole documents, in order of part, then block. A block can be decoded alone:
  ``payload`` holds the codes, most significant bit first; ``checkpoints`` the bit offset of every ``STEP``-th token;
  ``docs`` and ``lengths`` the documents' ids and numbers of tokens.

Spark writes both tables, so a task that is run again leaves no partial file behind.
"""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm._common import Scratch, parts, table, text_col
from corvane.llm.bpe import JOINED, PATTERN, Cut, Memo, byte_alphabet, specification

END, LIMIT, STEP, BLOCK = 0, 20, 256, 1 << 16
_BLOCKS = "part int, block int, n_tokens long, docs array<long>, lengths array<long>, payload binary, checkpoints array<long>"


class Encoder:
    """Ids of whole texts by the tokenizers library, each distinct piece of them encoded once while it is kept."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        specification(path)
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.alphabet = str.maketrans({chr(b): c for b, c in byte_alphabet().items()})
        self.find = regex.compile(PATTERN).findall
        self.words, self.marks = Memo(self.word, 200_000), Memo(self.word, 10_000)
        self.size = self.library.get_vocab_size()
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.clear()
        self.cut = Cut([t.content for t in self.library.get_added_tokens_decoder().values()], self.learn, self.clear)

    def clear(self):
        """Row i of the table: ``sizes[i]`` ids from ``starts[i]`` on."""
        self.flat, self.starts, self.sizes = np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def word(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.alphabet))]

    def learn(self, pieces: list[str], inner: bool) -> None:
        """Most pieces are letters, or letters and ASCII marks behind them; the others are cut by the word pattern."""
        lead, tokenize, words, find, alphabet, marks = " " if inner else "", self.model.tokenize, self.words, self.find, self.alphabet, self.marks
        head, punctuation = lead.translate(alphabet), string.punctuation
        ids: list[int] = []
        ends: list[int] = []
        for p in pieces:
            if inner and p.startswith(JOINED):
                for w in find(p[1:]):
                    ids += words[w]
                ends.append(len(ids))
                continue
            core = p.rstrip(punctuation)
            if core.isalpha() and ((plain := core.isascii()) or max(core) < "\u0530"):
                ids += [t.id for t in tokenize(head + (core if plain else core.encode().decode("latin-1").translate(alphabet)))]
                if len(core) < len(p):
                    ids += marks[p[len(core) :]]
            else:
                for w in find(lead + p):
                    ids += words[w]
            ends.append(len(ids))
        sizes = np.diff(np.array(ends, np.int64), prepend=0)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, np.array(ids, self.kind)])

    def encode(self, texts: pa.Array, end: int, docs: int = 1000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of texts without null, each followed by ``end``, and the number of ids before each text and in all;
        for ``docs`` texts at a time."""
        for part, odd, rows, offsets in self.cut(texts):
            for a in range(0, len(part), docs):
                b = min(a + docs, len(part))
                own, upto = rows[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                extra = [self.packed(self.library.encode(part[i].as_py(), add_special_tokens=False).ids) for i in (a + np.flatnonzero(odd[a:b])).tolist()]
                flat = np.concatenate([self.flat, np.frombuffer(b"".join([*extra, self.packed([end])]), self.kind)])
                sizes = np.array([len(x) // self.kind.itemsize for x in extra] + [1], np.int64)
                starts = np.concatenate([self.starts, len(flat) - sizes.sum() + np.cumsum(sizes) - sizes])
                own[upto[:-1][odd[a:b]]] = len(self.starts) + np.arange(len(extra))
                own = np.insert(own, upto[1:], len(starts) - 1)
                n = np.concatenate([self.sizes, sizes])[own]
                ends = np.cumsum(n)
                at = np.repeat(starts[own] - ends + n, n)
                at += np.arange(len(at))
                yield flat[at], np.concatenate([[0], ends[upto[1:] + np.arange(b - a)]])

    def __call__(self, text: str) -> bytes:
        ids, offsets = next(self.encode(pa.array([text]), END))
        return ids[:-1].tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more symbols than codes of this length")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.int64)
    own, flags = leaves, [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        packages = own[: len(own) // 2 * 2].reshape(-1, 2).sum(1)
        order = np.argsort(np.concatenate([leaves, packages]), kind="stable")
        own = np.concatenate([leaves, packages])[order]
        flags.append(order < len(leaves))
    lengths, take = np.zeros(len(leaves), np.uint8), 2 * len(leaves) - 2
    for flag in reversed(flags):
        n = int(flag[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    out[used] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    code, last = 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for i in order[lengths[order] > 0].tolist():
        n = int(lengths[i])
        code <<= n - last
        codes[i], last = code, n
        code += 1
    return codes


def encode(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The payload, and the bit offset of every ``STEP``-th token."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    at = ends - n
    out = np.zeros((int(ends[-1]) + 63) // 64 + 1, np.uint64)
    word, shift, code = at >> 6, 64 - (at & 63) - n, codes[ids]
    over = np.flatnonzero(shift < 0)
    high = code << np.maximum(shift, 0).view(np.uint64)
    high[over] = code[over] >> (-shift[over]).view(np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] = np.bitwise_or.reduceat(high, first)
    out[word[over] + 1] |= code[over] << (64 + shift[over]).view(np.uint64)
    return out.astype(">u8").tobytes()[: (int(ends[-1]) + 7) // 8], at[::STEP]


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for each value of the next ``LIMIT`` bits."""
    symbols, sizes = np.zeros(1 << LIMIT, np.uint32), np.zeros(1 << LIMIT, np.int64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = (1 << (LIMIT - lengths[order].astype(np.int64))).astype(np.int64)
    symbols[: spans.sum()] = np.repeat(order, spans)
    sizes[: spans.sum()] = np.repeat(lengths[order].astype(np.int64), spans)
    return symbols, sizes


def decode(blocks: list[tuple[bytes, np.ndarray, int]], tables: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Ids of blocks (payload, checkpoints, number of tokens); all stretches between checkpoints step together."""
    symbols, sizes = tables
    pad = b"\0" * (STEP * LIMIT // 8 + 8)
    data = np.frombuffer(b"".join([p for p, _, _ in blocks]) + pad, np.uint8).astype(np.uint32)
    window = data[:-3] << np.uint32(24) | data[1:-2] << np.uint32(16) | data[2:-1] << np.uint32(8) | data[3:]
    base = np.cumsum([0, *[len(p) for p, _, _ in blocks]])
    at = np.concatenate([np.asarray(c, np.int64) + 8 * b for (_, c, _), b in zip(blocks, base)])
    out = np.empty((STEP, len(at)), np.uint32)
    mask = np.uint32((1 << LIMIT) - 1)
    for i in range(STEP):
        key = window[at >> 3] >> (32 - LIMIT - (at & 7)).astype(np.uint32) & mask
        out[i] = symbols[key]
        at += sizes[key]
    lanes, k, found = out.T, 0, []
    for _, checkpoints, n in blocks:
        found.append(lanes[k : k + len(checkpoints)].ravel()[:n])
        k += len(checkpoints)
    return found


_IDS = pa.schema([("doc", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])


def _tokenize(path: str):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        counts = np.zeros(max(e.size, END + 1), np.int64)
        for batch in batches:
            at = 0
            for ids, offsets in e.encode(batch["text"], END):
                counts += np.bincount(ids, minlength=len(counts))
                n = len(offsets) - 1
                blobs = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((offsets * e.kind.itemsize).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch["doc"].slice(at, n), blobs, pa.nulls(n, pa.binary())], schema=_IDS)
                at += n
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())], schema=_IDS)

    return of


def _count_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = None
    for batch in batches:
        for blob in batch["counts"]:
            own = np.frombuffer(blob, np.int64)
            total = own.copy() if total is None else total + own
    if total is not None:
        at = np.flatnonzero(total)
        yield pd.DataFrame({"id": at.astype("int32"), "n": total[at]})


def _write_blocks(kind: str, lengths: np.ndarray):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, part, block = canonical(lengths), TaskContext.get().partitionId(), 0
        docs, held, n = [], [], 0

        def flush():
            nonlocal docs, held, n, block
            payload, checkpoints = encode(np.concatenate(held), lengths, codes)
            row = pd.DataFrame({"part": [part], "block": [block], "n_tokens": [n], "docs": [docs], "lengths": [[len(x) for x in held]], "payload": [payload], "checkpoints": [checkpoints]})
            docs, held, n, block = [], [], 0, block + 1
            return row

        for batch in batches:
            for doc, ids in zip(batch["doc"], batch["ids"]):
                docs.append(None if pd.isna(doc) else int(doc))
                held.append(np.frombuffer(ids, kind))
                n += len(held[-1])
                if n >= BLOCK:
                    yield flush()
        if held:
            yield flush()

    return of


def write_ids(docs: DataFrame, folder: str, path: str, *, id_col: str = "doc_id", text: str = "text") -> None:
    """Writes the ids of all texts, each with the end id, in ascending order of document id (nulls first).

    Null and empty texts have the end id alone; rows that repeat an id stand together; an empty table writes no block.
    Texts are tokenised once; their ids, two bytes each, and the counts wait in the shared folder.
    """
    import tokenizers

    spark = docs.sparkSession
    size = tokenizers.Tokenizer.from_file(path).get_vocab_size()
    kind = "<u2" if size <= 1 << 16 else "<u4"
    scratch = Scratch(spark, "ids")
    own = docs.select(F.col(id_col).cast("long").alias("doc"), text_col(text).alias("text"))
    ids = scratch.write(own.mapInArrow(_tokenize(path), "doc long, ids binary, counts binary"), "ids")
    found = ids.where("ids IS NULL").select("counts").mapInPandas(_count_rows, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # at most the vocabulary
    counts = np.zeros(max(size, END + 1), np.int64)
    counts[found["id"]] = found["n"]
    lengths = code_lengths(counts)
    at = np.flatnonzero(lengths)
    spark.createDataFrame(pd.DataFrame({"id": at.astype("int32"), "length": lengths[at].astype("int32")}), "id int, length int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/codebook")
    rows = ids.where("ids IS NOT NULL").select("doc", "ids").repartitionByRange(parts(spark), "doc").sortWithinPartitions("doc", "ids")
    rows.mapInPandas(_write_blocks(kind, lengths), _BLOCKS).write.mode("overwrite").parquet(f"{folder}/blocks")
    scratch.drop("ids")


def _read_blocks(lengths: np.ndarray, digest: bool):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = decode_table(lengths)
        for batch in batches:
            for i in range(0, len(batch), 16):
                own = batch.iloc[i : i + 16]
                out = []
                found = decode(list(zip(own["payload"], own["checkpoints"], own["n_tokens"])), tables)
                for part, block, docs, sizes, ids in zip(own["part"], own["block"], own["docs"], own["lengths"], found):
                    start = 0
                    for doc, n in zip(docs, sizes):
                        x = ids[start : start + n]
                        out.append((None if pd.isna(doc) else int(doc), part, block, start, n, zlib.crc32(x.astype("<u4").tobytes()) if digest else x))
                        start += n
                frame = pd.DataFrame(out, columns=["doc", "part", "block", "at", "n", "value"])
                frame["doc"] = frame["doc"].astype("Int64")
                yield frame

    return of


def read_ids(spark: SparkSession, folder: str, *, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, and ids (array), or with ``digest`` ids_crc32, from the
    files alone. The starts of blocks are running sums within their part and over the parts' totals."""
    book = spark.read.schema("id int, length int").parquet(f"{folder}/codebook").toPandas()  # at most the vocabulary
    lengths = np.zeros(int(book["id"].max()) + 1 if len(book) else 1, np.uint8)
    lengths[book["id"]] = book["length"]
    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    small = blocks.select("part", "block", "n_tokens")
    totals = small.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
    totals = totals.select("part", before(Window.orderBy("part")).alias("p"))  # a row for each part
    starts = small.select("part", "block", before(Window.partitionBy("part").orderBy("block")).alias("b")).join(totals, "part")
    value = "long" if digest else "array<long>"
    docs = blocks.mapInPandas(_read_blocks(lengths, digest), f"doc long, part int, block int, at long, n long, value {value}")
    out = docs.join(starts, ["part", "block"])
    return out.select(F.col("doc").alias("doc_id"), (F.col("p") + F.col("b") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), F.col("value").alias("ids_crc32" if digest else "ids"))


def op4_huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = Scratch(spark, "token-files").path("files")
    write_ids(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_ids(spark, folder, digest=True)
