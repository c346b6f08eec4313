"""Token counts by heap-and-linked-list byte-pair merging, without emitting identifiers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm._common import table, text_col
from corvane.llm.bpe import counter

VOCABULARY = "byte_bpe_50k.json"


def token_counts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens; special strings count one token each; repeated rows are counted
    each; an empty table gives no rows; other columns are ignored, whatever their names.
    """

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array(counter(path).counts(texts))

    own = docs.select(F.col(id_col).alias("doc_id"), text_col(text).alias("t"))
    out = own.select("doc_id", F.octet_length("t").cast("long").alias("n_bytes"), count("t").alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
