"""Curation of text records: validation with several reasons, deduplicated transforms, chat records and prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.columns import free
from corvane.operators import sampling
from corvane.sources.scratch import Scratch


def text_reasons(*texts: Column, run: int = 8, terms: dict[str, str] | None = None, variants: dict[str, str] | None = None) -> Column:
    """Reject labels that hold for any of the texts: leftover_placeholder, english_chunk, glossary."""
    found = [F.when(F.size(F.flatten(F.array(*[F.coalesce(T.leftover(t), F.array()) for t in texts]))) > 0, "leftover_placeholder")]
    runs = [T.longest_english_run(t) for t in texts]
    found.append(F.when((F.greatest(*runs) if len(runs) > 1 else runs[0]) >= run, "english_chunk"))
    if terms:
        found.append(F.when(sum(F.coalesce(F.size(T.term_violations(t, terms, variants or {})), F.lit(0)) for t in texts) > 0, "glossary"))
    return F.filter(F.array(*found), lambda r: r.isNotNull())


def through_distinct(df: DataFrame, column: str, transform: Callable[[DataFrame, str], DataFrame], into: str) -> DataFrame:
    """Applies a costly transform once for each distinct value: ``transform`` gets a frame of distinct values in
    ``column`` and returns it with ``into``; the results are joined back. Null stays null."""
    distinct = df.select(column).where(F.col(column).isNotNull()).distinct()
    return df.join(transform(distinct, column), column, "left")


def gated(df: DataFrame, source: str, first: Callable[[Column], Column], retry: Callable[[Column, Column], Column], into: str) -> DataFrame:
    """Transforms, checks, transforms refused rows once more with the reason at hand, and falls back to the source.

    Adds ``into`` and ``fault``, the reason if the source was kept. The first pass is written; only the rows that it
    refused are read for the second, so ``retry`` gets no other row. Null sources stay null.
    """
    scratch = Scratch(df.sparkSession, "gate")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (into, "fault")]
    one, why, two, left = free([*df.columns, into, "fault"], "one", "why", "two", "left")
    s = F.col(f"`{source}`")
    passed = df.withColumn(one, T.without_thoughts(first(s))).withColumn(why, F.when(s.isNotNull(), F.coalesce(T.translation_fault(s, F.col(one)), F.when(F.col(one).isNull(), "placeholder"))))
    passed = scratch.write(passed, "first")
    refused = passed.where(F.col(why).isNotNull()).withColumn(two, T.without_thoughts(retry(s, F.col(why))))
    refused = refused.withColumn(left, F.coalesce(T.translation_fault(s, F.col(two)), F.when(F.col(two).isNull(), F.col(why))))
    refused = scratch.write(refused, "second")
    fine = passed.where(F.col(why).isNull()).select(*kept, F.col(one).alias(into), F.lit(None).cast("string").alias("fault"))
    return fine.unionByName(refused.select(*kept, F.when(F.col(left).isNull(), F.col(two)).otherwise(s).alias(into), F.col(left).alias("fault")))


def chat_examples(df: DataFrame, system: str, *, question: list[str], answer: list[str], fen: str | None = None, into: str = "messages") -> DataFrame:
    """Three messages for each row with a question and an answer (the first filled alias of each); others are left out."""
    q, a = T.first_filled(*map(F.col, question)), T.first_filled(*map(F.col, answer))
    lead = F.when(T.strip(F.col(fen)) != "", F.concat(F.lit("FEN: "), F.col(fen), F.lit("\n"))).otherwise("") if fen else F.lit("")
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    rows = df.where(q.isNotNull() & a.isNotNull())
    return rows.withColumn(into, F.array(message("system", F.lit(system)), message("user", F.concat(F.coalesce(lead, F.lit("")), q)), message("assistant", a)))


def history(turns: DataFrame, conversation: str, order: str, role: str, text: str, names: dict[str, str]) -> DataFrame:
    """One text for each conversation: ``name: text`` by line, in order of turns. Roles without a name keep theirs."""
    name = F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col(role)], F.col(role)) if names else F.col(role)
    line = F.struct(F.col(order).alias("o"), F.concat_ws(": ", name, F.col(text)).alias("line"))
    return turns.groupBy(conversation).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("history"))


def examples(df: DataFrame, order: str, *, system: str, limit: int | None = None, question: tuple[str, ...] = ("question", "prompt", "instruction"), answer: tuple[str, ...] = ("answer", "completion", "response"), fen: str = "fen") -> DataFrame:
    """``chat_examples`` of the aliases a frame has, in ``order``; ``limit`` counts rows that are kept. A frame without
    a column for questions or for answers gives no rows."""
    have = lambda names: [n for n in names if n in df.columns]
    q, a = have(question), have(answer)
    if not q or not a:
        return df.limit(0).withColumn("messages", F.lit(None).cast("array<struct<role:string,content:string>>"))
    rows = chat_examples(df, system, question=q, answer=a, fen=fen if fen in df.columns else None)
    return rows if limit is None else rows.orderBy(order).limit(limit)


def rl_rows(puzzles: DataFrame, key: str, system: str, user: str, *, limit: int | None = None, seed: int = sampling.SEED) -> DataFrame:
    """(prompt messages, fen, solution, primary_theme, rating_bucket) in balanced order. ``limit`` counts puzzles before
    those without position or solution are left out. ``user``: a format string for the position."""
    rows = sampling.balanced_order(puzzles, key, limit, seed=seed).where(F.col("fen").isNotNull() & (F.size("solution") > 0))
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    ask = F.array(message("system", F.lit(system)), message("user", F.format_string(user, F.col("fen"))))
    return rows.select(ask.alias("prompt"), "fen", "solution", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("primary_theme", "rating_bucket")])


def dialogue(messages: Column) -> Column:
    """The turns of an array of messages that have a role; raises where none is left."""
    turns = F.filter(messages, lambda m: m.isNotNull() & m["role"].isNotNull())
    return F.when(F.coalesce(F.size(turns), F.lit(0)) > 0, turns).otherwise(F.raise_error(F.lit("no message")).cast("array<struct<role:string,content:string>>"))


def first_fine(attempts: DataFrame, key: str, attempt: str, text: str, fine: Column, fallback: Column | str, most: int) -> DataFrame:
    """For each key the text of the earliest of its first ``most`` attempts that is fine, else the fallback."""
    rows = attempts.where(F.col(attempt) < most)
    best = F.min_by(F.when(fine, F.col(text)), F.when(fine, F.col(attempt)))
    keys = attempts.select(key).distinct()
    return keys.join(rows.groupBy(key).agg(best.alias("answer")), key, "left").withColumn("answer", F.coalesce("answer", F.lit(fallback) if isinstance(fallback, str) else fallback))
