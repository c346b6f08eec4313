"""Validation of translated records: every reason for which a record is refused, and a job that parts them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.chess import udf as K
from corvane.functions import terms as terms_module
from corvane.functions import text as T
from corvane.functions.columns import free
from corvane.operators.curate import through_distinct
from corvane.operators.positions import label_reasons
from corvane.sources import records

#: Text columns, the longest English run below which a text is fine, and the share of refusals that alarms.
FIELDS, RUN, ALARM = ("question", "answer"), 8, 0.25


def validated(
    rows: DataFrame, *, fields: tuple[str, ...] = FIELDS, fen: str | None = "fen", label: str | None = "label", run: int = RUN, strict_moves: bool = False,
    terms: dict[str, str] | None = None, variants: dict[str, str] | None = None, known: Column | None = None,
) -> DataFrame:
    """``rows`` with ``reason`` and ``reason_detail``, arrays in step; both are empty for a record that passes.

    A record whose position is missing or is none has ``missing_fen`` alone. For others all reasons gather, in this
    order: invalid_move (with ``strict_moves``: an unambiguous move that no variation of its text accepts), bad_label or
    label_mismatch (the label against the move that the last text concludes with; not without a label),
    leftover_placeholder, english_chunk, glossary. Text columns that a frame lacks, or that hold no text, are passed
    over; so is ``label``. ``known`` replaces the test of positions by one of the caller's; without it each distinct
    position is read once. ``fen=None``: records have no position and need none.
    """
    have = {n: t for n, t in rows.dtypes}
    texts = [n for n in fields if have.get(n) == "string"]
    terms = terms_module.TERMS if terms is None else terms
    variants = terms_module.VARIANTS if variants is None else variants
    empty = F.array().cast("array<struct<reason:string,detail:string>>")
    note = lambda reason, detail: F.struct(F.lit(reason).alias("reason"), detail.alias("detail"))
    joined = lambda a: F.array_join(a, ", ")
    df = rows
    fine, illegal, mislabelled, longest, wrong_terms, why = free(rows, "fine", "illegal", "mislabelled", "longest", "wrong_terms", "why")
    if fen is None:
        valid = F.lit(True)
    elif known is not None:
        valid = F.coalesce(known, F.lit(False))
    else:
        df = through_distinct(df, fen, lambda d, c: d.withColumn(fine, K.fen_valid(c)), fine)
        valid = F.coalesce(fine, F.lit(False))
    found = []
    if strict_moves and fen and texts:
        df = df.withColumn(illegal, K.illegal_moves(F.array(*map(F.col, texts)), F.col(fen)))
        found.append(F.when(F.size(illegal) > 0, note("invalid_move", F.concat(F.lit("illegal: "), joined(F.col(illegal))))))
    if label and fen and have.get(label) == "string":
        said = F.col(texts[-1]) if texts else F.lit(None).cast("string")
        df = df.withColumn(mislabelled, F.try_element_at(label_reasons(said, F.col(fen), F.col(label)), F.lit(1)))
        found.append(F.when(F.col(mislabelled).isNotNull(), F.struct(F.col(mislabelled).alias("reason"), F.concat(F.lit("label: "), F.col(label)).alias("detail"))))
    if texts:
        all_texts = [F.coalesce(F.col(n), F.lit("")) for n in texts]
        left = F.array_sort(F.array_distinct(F.flatten(F.array(*map(T.placeholders, all_texts)))))
        found.append(F.when(F.size(left) > 0, note("leftover_placeholder", F.concat(F.lit("left: "), joined(left)))))
        runs = [T.longest_english_run(t) for t in all_texts]
        df = df.withColumn(longest, F.when(valid, F.greatest(*runs) if len(runs) > 1 else runs[0]))
        found.append(F.when(F.col(longest) >= run, note("english_chunk", F.format_string("run of %d words", F.col(longest)))))
        wrong = F.flatten(F.array(*[T.term_violations(t, terms, variants) for t in all_texts])) if terms else None
        if wrong is not None:
            pairs = F.array_sort(F.array_distinct(F.transform(wrong, lambda v: F.concat(v["found"], F.lit(" -> "), v["expected"]))))
            df = df.withColumn(wrong_terms, F.when(valid, pairs))
            found.append(F.when(F.size(wrong_terms) > 0, note("glossary", joined(F.col(wrong_terms)))))
    gathered = F.filter(F.array(*found), lambda x: x.isNotNull()) if found else empty
    missing = F.array(note("missing_fen", F.concat(F.lit("position: "), F.coalesce(F.col(fen).cast("string"), F.lit("none"))) if fen else F.lit("")))
    df = df.withColumn(why, F.when(valid, gathered).otherwise(missing))
    reason, detail = F.transform(why, lambda x: x["reason"]), F.transform(why, lambda x: x["detail"])
    return df.select(*[F.col(f"`{c}`") for c in rows.columns], reason.alias("reason"), detail.alias("reason_detail"))


def part(spark_rows: DataFrame, clean: str, rejected: str, scratch: str, **options) -> DataFrame:
    """Validates once into the folder ``scratch``, writes the records that pass to ``clean`` (nothing if none does) and
    the others, with their reasons, to ``rejected`` as JSON lines (always). Returns the validated rows as written."""
    validated(spark_rows, **options).write.mode("overwrite").parquet(scratch)
    both = spark_rows.sparkSession.read.parquet(scratch)
    records.write_clean(both.where(F.size("reason") == 0).drop("reason", "reason_detail"), clean)
    records.write_jsonl(both.where(F.size("reason") > 0), rejected)
    return both
