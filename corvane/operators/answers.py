"""Evaluation of a model on puzzles: answers, the moves they conclude with, accuracy, and false claims."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.chess import udf as K
from corvane.functions import text as T
from corvane.functions.columns import free
from corvane.operators import evaluate
from corvane.operators.claims import with_claims
from corvane.operators.curate import through_distinct
from corvane.operators.positions import with_facts
from corvane.operators.prompts import facts_prompt, facts_text, prompt, puzzle_prompt
from corvane.operators.prompts import fallback as fallback_text
from corvane.sources.scratch import Scratch

#: Attempts after the first, what each adds to the temperature, and what the prompt then adds.
REGENERATIONS, STEP = 2, 0.1
AGAIN = "\nLƯU Ý: câu trả lời trước có nước đi không hợp lệ. Chỉ dùng nước trong danh sách nước đi hợp lệ ở trên."

#: A predictor answers a batch of prompts; ``load`` makes it once for each task, where a model would be loaded.
Predictor = Callable[[list[str]], list[str]]


def echo(answer: str) -> Callable[[], Predictor]:
    """A predictor that gives one answer to all."""
    return lambda: lambda prompts: [answer] * len(prompts)


def predicted(rows: DataFrame, load: Callable[[], Predictor], prompt: Column, into: str = "answer", *, batch: int = 8) -> DataFrame:
    """``rows`` with the answers to ``prompt``. A predictor that returns another number of answers raises.

    The predictor is loaded once a task and gets ``batch`` prompts at a time."""


    @F.pandas_udf("string")
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = None
        for asked in batches:
            model = model or load()
            out: list[str] = []
            given = asked.tolist()
            for i in range(0, len(given), batch):
                got = model(given[i : i + batch])
                if len(got) != len(given[i : i + batch]):
                    raise RuntimeError(f"the predictor returned {len(got)} of {len(given[i:i + batch])} answers")
                out += got
            yield pd.Series(out, dtype=object)

    return rows.withColumn(into, answer.asNondeterministic()(prompt))  # never asked twice for one row


def regenerated(
    rows: DataFrame, load: Callable[[float], Predictor], prompt: Callable[[int, Column], Column], fine: Callable[[Column], Column], fallback: Column | str, *, regenerations: int = REGENERATIONS,
    temperature: float = 0.0, step: float = STEP, into: str = "answer", batch: int = 8,
) -> DataFrame:
    """``rows`` with an answer that is ``fine``, the attempt it came with (from 0) and the temperature; rows of which no
    attempt is fine get ``fallback``, with attempt and temperature null.

    In rounds over a shrinking frame: each asks only for the rows that no earlier round answered well, at a temperature
    that grows by ``step``. ``prompt`` gets the attempt and the last text, null at first, and may use the rows' columns;
    ``load(temperature)`` makes the predictor of a round. Each round is written once, with its texts and verdicts, so that
    no model is asked twice; rounds end when no row is left, or after ``regenerations`` more than the first.
    """
    scratch = Scratch(rows.sparkSession, "rounds")
    own = [c for c in rows.columns if c not in (into, "attempt", "temperature")]
    last, text, ok = free([*rows.columns, into, "attempt", "temperature"], "last", "text", "ok")
    done = lambda df, answer, attempt, heat: df.select(*[F.col(f"`{c}`") for c in own], answer.alias(into), F.lit(attempt).cast("int").alias("attempt"), F.lit(heat).cast("double").alias("temperature"))
    left = rows.select(*[F.col(f"`{c}`") for c in own]).withColumn(last, F.lit(None).cast("string"))
    out = None
    for attempt in range(regenerations + 1):
        heat = round(temperature + step * attempt, 9)
        told = scratch.write(predicted(left, lambda heat=heat: load(heat), prompt(attempt, F.col(last)), text, batch=batch), f"told{attempt}")
        told = scratch.write(told.withColumn(ok, F.coalesce(fine(F.col(text)), F.lit(False))), f"round{attempt}")
        scratch.drop(f"told{attempt}")
        good = done(told.where(F.col(ok)), F.col(text), attempt, heat)
        out = good if out is None else out.unionByName(good)
        left = told.where(~F.col(ok)).drop(last, ok).withColumnRenamed(text, last)
        if attempt < regenerations and left.isEmpty():
            return out
    return out.unionByName(done(left, F.lit(fallback) if isinstance(fallback, str) else fallback, None, None))


def guarded(rows: DataFrame, load: Callable[[float], Predictor], *, fen: str = "fen", question: str = "question", regenerations: int = REGENERATIONS, temperature: float = 0.0) -> DataFrame:
    """``rows`` (a position and a question) with an answer of which every move is legal, by ``regenerated``. The prompt
    tells the facts of the position, and from the second attempt on that the last answer had a move that is not legal;
    the fallback tells facts only. Rows of what is no position are left out."""
    known = Scratch(rows.sparkSession, "facts").write(with_facts(playable(rows, fen=fen)), "rows")
    ask = lambda attempt, last: F.concat(prompt(facts_text(F.col("facts")), F.col(question)), F.lit(AGAIN if attempt else ""))
    return regenerated(known, load, ask, lambda text: K.guard(text, F.col(fen))["ok"], fallback_text(F.col("facts")), regenerations=regenerations, temperature=temperature).drop("facts")


def playable(puzzles: DataFrame, *, fen: str = "fen") -> DataFrame:
    """The puzzles with a position; each distinct one is read once."""
    (fine,) = free(puzzles, "fine")
    known = through_distinct(puzzles, fen, lambda d, c: d.withColumn(fine, K.fen_valid(c)), fine)
    return known.where(F.coalesce(fine, F.lit(False))).drop(fine)


def puzzle_results(puzzles: DataFrame, load: Callable[[], Predictor], *, system: str = "", with_all_facts: bool = False, build: Callable[[Column], Column] | None = None, limit: int | None = None, order: str = "puzzle_id") -> DataFrame:
    """From (puzzle_id, fen, solution array, rating_bucket, primary_theme): puzzle_id, rating_bucket, theme, expected,
    predicted (UCI), correct, legal. ``limit`` counts puzzles with a position, in order of ``order``. ``build`` makes the
    prompt of a position's column; without it the prompt is the bare position, or all facts with ``with_all_facts``."""
    if build is not None and with_all_facts:
        raise ValueError("give either a builder of prompts or with_all_facts")
    rows = playable(puzzles)
    if limit is not None:
        rows = rows.orderBy(order).limit(limit)
    rows = rows.select("puzzle_id", "fen", F.try_element_at("solution", F.lit(1)).alias("__first"), *[F.coalesce(F.col(c), F.lit("?")).alias(c) for c in ("rating_bucket", "primary_theme")])
    if with_all_facts:
        rows = with_facts(rows)
        answered = predicted(rows.withColumn("__ask", facts_prompt(F.col("facts"))).drop("facts"), load, F.col("__ask")).drop("__ask")
    else:
        answered = predicted(rows, load, build(F.col("fen")) if build else puzzle_prompt(F.col("fen"), system))
    move = K.concluding_move(F.col("answer"), F.col("fen"), T.answer(F.col("answer")))
    uci_only = F.when(F.col("__first").rlike("^[a-h][1-8][a-h][1-8][qrbn]?$"), K.read_move("fen", "__first"))
    out = answered.withColumns({"expected": uci_only, "predicted": move})
    right = F.coalesce(F.col("predicted") == F.col("expected"), F.lit(False))
    return out.select("puzzle_id", "rating_bucket", F.col("primary_theme").alias("theme"), "expected", "predicted", right.alias("correct"), F.col("predicted").isNotNull().alias("legal"))


def accuracy_report(results: DataFrame) -> DataFrame:
    """Overall, by rating bucket and by theme."""
    return evaluate.accuracy(results, ["rating_bucket", "theme"])


def generated(puzzles: DataFrame, load: Callable[[], Predictor], *, system: str = "", limit: int | None = None, order: str = "puzzle_id") -> DataFrame:
    """(puzzle_id, fen, answer) of puzzles with a text for a position; ``limit`` counts these."""
    rows = puzzles.where("fen IS NOT NULL")
    if limit is not None:
        rows = rows.orderBy(order).limit(limit)
    return predicted(rows.select("puzzle_id", "fen"), load, puzzle_prompt(F.col("fen"), system))


def claims_figures(answers: DataFrame, key: str = "puzzle_id") -> DataFrame:
    """``evaluate.claims_report`` of answers with a position, and a row ``answers`` with how many there are (also those
    without any claim) and how many hold a false one."""
    known = with_claims(answers)
    each = known.select(key, F.explode("claims").alias("c")).select(key, "c.kind", "c.is_true")
    report = evaluate.claims_report(each, key)
    false = F.exists("claims", lambda c: ~c["is_true"])
    n = known.agg(F.sum(F.size("claims")).alias("claims"), F.sum(F.size(F.filter("claims", lambda c: ~c["is_true"]))).alias("false_claims"), F.count("*").alias("answers"), F.sum(false.cast("long")).alias("answers_with_error"))
    return report.unionByName(n.select(F.lit("answers").alias("kind"), F.coalesce(F.col("claims"), F.lit(0)).cast("long").alias("claims"), F.coalesce(F.col("false_claims"), F.lit(0)).cast("long").alias("false_claims"), F.coalesce(F.col("answers_with_error") / F.col("answers"), F.lit(0.0)).alias("rate"), "answers", F.coalesce("answers_with_error", F.lit(0)).cast("long").alias("answers_with_error")))
