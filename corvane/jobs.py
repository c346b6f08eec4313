"""Jobs from a command line: ``python -m corvane.jobs NAME …``. Each returns an exit code: 0, 1 for an empty result, 2
for a call that lacks what it needs."""

from __future__ import annotations

import argparse
import sys
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.columns import free
from corvane.operators import answers, evaluate, positions, reports, sampling, translate, validate
from corvane.operators.memory import TranslationMemory
from corvane.sources import records
from corvane.sources.ordinals import numbered
from corvane.sources.scratch import Scratch
from corvane.streaming.jobs import resumable
from corvane.streaming.ledger import run_by_rows

#: The one question of all normalised records, sizes of a sample, and the batches of a translation.
QUESTION = "Find the best move for the side to play. Analyze step by step and explain your reasoning."
TRAIN, TEST, BATCH_FILES, BATCH_ROWS, TRIES, SAMPLES = 50_000, 2_000, 16, 1_000_000, 3, 20


def _numbered(rows: DataFrame, name: str = "row") -> tuple[DataFrame, str]:
    """``rows`` with their number, from 0 in order of the files they were read from, and its column's name."""
    (name,) = free(rows, name)
    return numbered(rows, name), name


def normalise(spark: SparkSession, source: str, target: str | None, limit: int | None = None) -> int:
    """Questions with positions from raw instructions; without ``target`` only the report. ``limit`` counts good rows."""
    raw, row = _numbered(records.read_records(spark, source))
    raw = raw.withColumn("id", F.coalesce(F.col("id"), F.col(row)) if "id" in raw.columns else F.col(row)).drop(row)
    both = Scratch(spark, "normalise").write(positions.normalise(raw, QUESTION), "rows")
    good = both.where("reason IS NULL").drop("reason")
    good = good if limit is None else good.orderBy("id").limit(limit)
    kept = good.count()
    print(reports.tally(kept, both.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))))
    if kept and target:
        records.write_jsonl(good, target)
    return 0 if kept else 1


def translate_files(spark: SparkSession, source: str | None, target: str, checkpoint: str, translator: translate.Translator = translate.echo, schema: str = "id long, fen string, question string, answer string, label string") -> int:
    """Resumable translation of a folder of JSON lines to which files are added."""
    if not source:
        return 2
    resumable(spark, source, schema, lambda batch: translate.translated(batch, translator), target, checkpoint, files_per_batch=BATCH_FILES, kind="json", tries=TRIES)
    return 0


def translate_rows(
    spark: SparkSession, source: str | None, target: str, translator: translate.Translator = translate.echo, *, retry=None, gate: bool = True, fields: list[str] | None = None, batch: int = BATCH_ROWS,
    limit: int | None = None, resume: bool = False, dry_run: bool = False, samples: int = SAMPLES, memory: str | None = None,
) -> int:
    """Translation of records by rows, with a ledger in the target folder. ``memory``: a folder of translations that
    batches, runs and writers share. A dry run prints the first records before and after, and writes nothing but what
    the memory learns."""
    if not source:
        return 2
    rows, row = _numbered(records.read_records(spark, source))
    fields = translate.detected_fields(rows) if fields is None else fields
    known = TranslationMemory(spark, memory) if memory else None
    refused: Counter[str] = Counter()

    def of(part: DataFrame) -> DataFrame:
        out, texts = translate.translated_with_texts(part, translator, fields, retry=retry, gate=gate, memory=known)
        refused.update({r["fault"]: r["n"] for r in translate.faults(texts).collect()})  # a row for each reason
        return out

    show = lambda before, after: print(records.preview(before, after, row, fields, samples))
    n = run_by_rows(rows, of, target, ordinal=row, batch=batch, limit=limit, resume=resume, dry_run=dry_run, samples=samples, tries=TRIES, show=show)
    print(f"{n} records" + "".join(f", {k}: {v}" for k, v in refused.most_common()))
    return 0


def validate_files(spark: SparkSession, source: str, clean: str | None, rejected: str | None, strict_moves: bool = False) -> int:
    scratch = Scratch(spark, "validate")
    rows = records.read_records(spark, source, strict=False)
    if rows.isEmpty():
        return 1
    both = validate.part(rows, clean or scratch.path("clean"), rejected or scratch.path("rejected"), scratch.path("all"), strict_moves=strict_moves)
    report = evaluate.reason_report(both, "reason")
    n = {r["reason"]: r["n"] for r in report.collect()}
    print(reports.reasons(report))
    if evaluate.alarm(n.get("rejected", 0), n["total"]):
        print(f"more than {validate.ALARM:.0%} of the records were refused")
    return 1 if clean and not n.get("passed") else 0


def sample_puzzles(spark: SparkSession, source: str, train: str, test: str, sizes: tuple[int, int] = (TRAIN, TEST), per_cell: int | None = None, max_scan: int | None = None) -> int:
    rows, row = _numbered(records.read_records(spark, source))
    prepared = positions.puzzles(rows, extra=[row])
    sample, tally = sampling.balanced_sample(prepared, row, *sizes, per_cell=per_cell, max_scan=max_scan)
    sample = Scratch(spark, "puzzles").write(sample.drop(row, "error"), "sample")
    for name, path in (("train", train), ("test", test)):
        part = sample.where(F.col("split") == name)
        if not part.isEmpty():
            part.drop("split").write.mode("overwrite").parquet(path)
        counts = lambda c: part.groupBy(c).agg(F.count("*").alias("n"))  # noqa: B023, E731
        print(reports.distribution(name, counts("rating_bucket"), counts("primary_theme")))
    print(reports.tally(sample.count(), tally))
    return 1 if sample.where("split = 'train'").isEmpty() else 0


def puzzle_accuracy(spark: SparkSession, source: str, target: str | None, load=None, model: str = "echo", limit: int | None = None, with_all_facts: bool = False) -> int:
    if load is None:
        return 2
    results = Scratch(spark, "accuracy").write(answers.puzzle_results(records.read_records(spark, source), load, limit=limit, with_all_facts=with_all_facts), "results")
    report = answers.accuracy_report(results)
    print(reports.accuracy(model, report))
    if results.isEmpty():
        return 1
    if target:
        records.write_report(report.withColumn("model", F.lit(model)), target)
    return 0


def false_claims(spark: SparkSession, source: str, target: str | None, load=None, model: str = "echo", limit: int | None = None) -> int:
    """Of answers in a file, or of a model's answers to puzzles if ``load`` is given."""
    rows = records.read_records(spark, source)
    told = rows if load is None else answers.generated(rows, load, limit=limit)
    told = told if "puzzle_id" in told.columns else _numbered(told, "puzzle_id")[0]
    told = Scratch(spark, "claims").write(told.select("puzzle_id", "fen", "answer"), "answers")
    report = answers.claims_figures(told)
    print(reports.claims(model, report))
    if target:
        records.write_report(report.withColumn("model", F.lit(model)), target)
    return 0


def export_ratings(spark: SparkSession, source: str, target: str, size: int = 100) -> int:
    rows, row = _numbered(records.read_records(spark, source))
    return 0 if records.write_form(sampling.rating_form(rows, row, size), target) else 1


def collect_ratings(spark: SparkSession, paths: list[str], target: str | None, axes: tuple[str, ...] = ("naturalness", "terminology")) -> int:
    report = Scratch(spark, "ratings").write(evaluate.agreement(records.read_ratings(spark, paths, list(axes)), len(paths)), "report")
    print(reports.agreement(report))
    if target:
        records.write_report(report, target)
    return 0


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="corvane.jobs")
    jobs = parser.add_subparsers(dest="job", required=True)

    def job(name: str, *flags: str, **kinds) -> argparse.ArgumentParser:
        p = jobs.add_parser(name)
        for flag in flags:
            p.add_argument(flag, **kinds.get(flag.lstrip("-").replace("-", "_"), {}))
        return p

    whole, switch = {"type": int}, {"action": "store_true"}
    job("normalise", "source", "--target", "--limit", limit=whole)
    job("translate", "--source", "--target", "--checkpoint", "--fields", "--batch-rows", "--limit", "--resume", "--dry-run", "--memory", target={"required": True}, batch_rows=whole | {"default": BATCH_ROWS}, limit=whole, resume=switch, dry_run=switch)
    job("validate", "source", "--clean", "--rejected", "--strict-moves", strict_moves=switch)
    job("puzzles", "source", "--train", "--test", "--train-size", "--test-size", "--per-cell", "--max-scan", train={"required": True}, test={"required": True}, train_size=whole | {"default": TRAIN}, test_size=whole | {"default": TEST}, per_cell=whole, max_scan=whole)
    job("accuracy", "source", "--target", "--answer", "--limit", "--facts", limit=whole, facts=switch)
    job("claims", "source", "--target", "--answer", "--limit", limit=whole)
    job("export-ratings", "source", "target", "--size", size=whole | {"default": 100})
    job("collect-ratings", "paths", "--target", paths={"nargs": "+"})
    a = parser.parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    load = answers.echo(a.answer) if getattr(a, "answer", None) is not None else None
    return {
        "normalise": lambda: normalise(spark, a.source, a.target, a.limit),
        "translate": lambda: translate_files(spark, a.source, a.target, a.checkpoint) if a.checkpoint else translate_rows(spark, a.source, a.target, fields=a.fields.split(",") if a.fields else None, batch=a.batch_rows, limit=a.limit, resume=a.resume, dry_run=a.dry_run, memory=a.memory),
        "validate": lambda: validate_files(spark, a.source, a.clean, a.rejected, a.strict_moves),
        "puzzles": lambda: sample_puzzles(spark, a.source, a.train, a.test, (a.train_size, a.test_size), a.per_cell, a.max_scan),
        "accuracy": lambda: puzzle_accuracy(spark, a.source, a.target, load, limit=a.limit, with_all_facts=a.facts),
        "claims": lambda: false_claims(spark, a.source, a.target, load, limit=a.limit),
        "export-ratings": lambda: export_ratings(spark, a.source, a.target, a.size),
        "collect-ratings": lambda: collect_ratings(spark, a.paths, a.target),
    }[a.job]()


if __name__ == "__main__":
    sys.exit(main())
