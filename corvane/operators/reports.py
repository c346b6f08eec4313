"""Small results as texts. Each frame is an aggregate with a row for each reason, slice or kind."""

from __future__ import annotations

from pyspark.sql import DataFrame

WIDTH = 56


def _share(n: float, total: float) -> str:
    return f"{100 * n / total:6.2f}%" if total else "     -"


def _page(head: list[str], *blocks: list[str]) -> str:
    rule = "-" * WIDTH
    return "\n".join(["=" * WIDTH, *head, *[line for b in blocks if b for line in (rule, *b)], "=" * WIDTH])


def reasons(report: DataFrame) -> str:
    """Of ``evaluate.reason_report``: the total, what passed and what did not, then reasons, the most frequent first."""
    n = {r["reason"]: r["n"] for r in report.collect()}
    total = n.pop("total", 0)
    line = lambda name, k: f"  {name:<32}{k:>10}{_share(k, total):>10}"
    head = [f"{'records':<34}{total:>10}", *[line(x, n.pop(x, 0))[2:] for x in ("passed", "rejected")]]
    return _page(head, [line(*x) for x in sorted(n.items(), key=lambda x: (-x[1], x[0]))])


def tally(kept: int, skipped: DataFrame) -> str:
    """How many rows were kept, and why the others (reason, n) were not, the most frequent first."""
    n = sorted(((r["reason"], r["n"]) for r in skipped.collect()), key=lambda x: (-x[1], x[0]))
    gone = sum(k for _, k in n)
    return _page([f"{name:<40}{k:>10}" for name, k in (("rows", kept + gone), ("kept", kept), ("skipped", gone))], [f"  {name:<38}{k:>10}" for name, k in n])


def distribution(title: str, buckets: DataFrame, themes: DataFrame) -> str:
    """Counts by rating bucket, in order of ratings, and by theme, the most frequent first."""
    b = sorted(map(tuple, buckets.collect()), key=lambda r: int(str(r[0]).lstrip("-").split("-")[0]) * (-1 if str(r[0]).startswith("-") else 1))
    t = sorted(map(tuple, themes.collect()), key=lambda r: (-r[1], r[0]))
    total = sum(r[1] for r in b)
    lines = lambda rows: [f"  {r[0]:<24}{r[1]:>8}{_share(r[1], total):>10}" for r in rows]
    return _page([f"{title}: {total}"], ["by rating", *lines(b)], [f"by theme ({len(t)})", *lines(t)])


def accuracy(model: str, report: DataFrame) -> str:
    """Of ``evaluate.accuracy``: overall, then each slice in order of its values as texts."""
    rows = sorted(report.collect(), key=lambda r: (r["slice"] != "overall", r["slice"], r["value"]))
    whole, names = rows[0] if rows else None, list(dict.fromkeys(r["slice"] for r in rows[1:]))
    head = [f"model: {model}", f"correct: {whole['hits'] if whole else 0}/{whole['n'] if whole else 0}", f"legal: {_share(whole['legal_rate'] if whole else 0, 1)}"]
    return _page(head, *[[f"by {s}", *[f"  {r['value']:<24}{r['hits']:>5}/{r['n']:<6}{_share(r['hits'], r['n'])}" for r in rows if r["slice"] == s]] for s in names])


def claims(model: str, report: DataFrame) -> str:
    """Of ``answers.claims_figures``."""
    by = {r["kind"]: r for r in report.collect()}
    whole = by.pop("answers", None)
    by.pop("all", None)
    n = lambda c: whole[c] if whole else 0
    head = [f"model: {model}", f"answers: {n('answers')}", f"claims: {n('claims')}", f"false: {n('false_claims')} ({_share(n('false_claims'), n('claims')).strip()})", f"answers with a false claim: {n('answers_with_error')} ({_share(n('answers_with_error'), n('answers')).strip()})"]
    return _page(head, [f"  {k:<16}{r['false_claims']:>5}/{r['claims']:<6}{_share(r['false_claims'], r['claims'])}" for k, r in sorted(by.items())])


def agreement(report: DataFrame) -> str:
    """Of ``evaluate.agreement``."""
    rows = report.collect()
    raters, axes = sorted({r["who"] for r in rows if r["metric"] == "mean"}), sorted({r["axis"] for r in rows})
    of = {(r["axis"], r["metric"], r["who"]): r["value"] for r in rows}
    lines = [[axis, *[f"  mean {who:<20}{of[axis, 'mean', who]:8.2f}" for who in raters if (axis, "mean", who) in of], f"  kappa{of.get((axis, 'kappa', 'all'), 0):28.3f}", f"  within one{100 * of.get((axis, 'within_one', 'all'), 0):22.1f}%"] for axis in axes]
    return _page([f"raters: {', '.join(raters)}", f"rated by all: {max((r['n'] for r in rows), default=0)}"], *lines)
