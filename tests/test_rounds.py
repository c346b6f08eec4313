import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.chess import notation
from corvane.chess.position import START
from corvane.functions import terms as M
from corvane.functions import text as T
from corvane.operators import answers, sampling

# greedy sampling


def plain_fill(rows, cap):
    """(key, bucket, themes, order) one after another."""
    count, taken, out = {}, set(), {}
    for key, bucket, themes, order in sorted(rows, key=lambda r: r[3]):
        theme = min([t for t in themes or [] if t is not None] or ["untagged"], key=lambda t: (count.get((bucket, t), 0), t))
        if key in taken:
            out[order] = (None, "duplicate")
        elif count.get((bucket, theme), 0) >= cap:
            out[order] = (None, "cell_full")
        else:
            count[bucket, theme] = count.get((bucket, theme), 0) + 1
            taken.add(key)
            out[order] = (theme, "accepted")
    return out


@pytest.mark.parametrize("head,few", [(100_000, 100_000), (7, 100_000), (40, 0)])
def test_rounds_equal_a_plain_loop(spark, monkeypatch, head, few):
    monkeypatch.setattr(sampling, "FEW", few)  # small tables are joined by a shuffle beyond it
    rng = random.Random(head)
    pick = lambda: rng.choice([None, [], ["a"], ["a", "b"], ["b", "c", "d"], [None, "d"], ["e"]])
    rows = [(rng.choice([None, *range(150)]), rng.choice(["0-399", "0-399", "400-799", None]), pick(), i) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, bucket string, themes array<string>, b int").withColumn("k", F.lit(1))
    got = {r.b: (r.primary_theme, r.status) for r in sampling.least_filled(df, "bucket", "themes", "id", "b", 6, head=head).collect()}
    want = plain_fill(rows, 6)
    assert got == want and {s for _, s in want.values()} == {"accepted", "duplicate", "cell_full"}


def test_an_id_in_two_buckets_is_sampled_once(spark):
    rows = [("a", 0, "400-799", ["x"], None), ("a", 1, "800-1199", ["x"], None), ("b", 2, "800-1199", ["x"], None), ("b", 3, "800-1199", ["y"], "bad_fen")]
    df = spark.createDataFrame(rows, "puzzle_id string, at int, rating_bucket string, themes array<string>, error string")
    sample, tally = sampling.balanced_sample(df, "at", 5, 5, per_cell=9)
    assert sorted((r.puzzle_id, r.at) for r in sample.collect()) == [("a", 0), ("b", 2)]
    assert {r.reason: r.n for r in tally.collect()} == {"duplicate": 1, "bad_fen": 1}


# regeneration


def test_each_round_asks_for_what_is_left(spark):
    df = spark.createDataFrame([(i, f"t{i}", "x") for i in range(30)], "id int, text string, last string")
    seen = {heat: spark.sparkContext.accumulator(0) for heat in (0.5, 0.6, 0.7)}

    def load(heat):
        def answer(asked):
            seen[heat].add(len(asked))
            return [f"{heat} {a}" for a in asked]

        return answer

    passes = {0.5: 0, 0.6: 2, 0.7: 3}  # of each round: ids that it divides
    fine = lambda a: F.coalesce(*[F.when(a.startswith(str(h)), F.lit(d > 0) & (F.col("id") % max(1, d) == 0)) for h, d in passes.items()])
    ask = lambda attempt, last: F.concat_ws("|", F.lit(str(attempt)), F.col("text"), last)
    out = {r.id: r for r in answers.regenerated(df, load, ask, fine, F.concat(F.lit("facts of "), "text"), temperature=0.5).collect()}
    assert [seen[h].value for h in passes] == [30, 30, 15] and len(out) == 30
    assert (out[4].answer, out[4].attempt, out[4].temperature) == ("0.6 1|t4|0.5 0|t4", 1, 0.6)
    assert out[9].attempt == 2 and out[9].answer.startswith("0.7 2|t9|0.6 1|t9") and out[9].last == "x"
    assert (out[5].answer, out[5].attempt, out[5].temperature) == ("facts of t5", None, None)
    before = seen[0.6].value
    one = answers.regenerated(df, load, ask, lambda a: F.lit(True), "none", temperature=0.5)
    assert one.count() == 30 and seen[0.6].value == before  # nothing is left for a second round
    assert answers.regenerated(df.limit(0), load, ask, fine, "none", temperature=0.5).count() == 0


def test_guarded_answers(spark):
    df = spark.createDataFrame([(1, START, "?"), (2, START, "!"), (3, "bad", "?")], "id int, fen string, question string")
    said = lambda heat: lambda asked: ["Play Nf3." if heat and "LƯU Ý" in a and "\n!" not in a else "Play Qh5 now." for a in asked]
    out = {r.id: r for r in answers.guarded(df, said).collect()}
    assert set(out) == {1, 2} and (out[1].answer, out[1].attempt) == ("Play Nf3.", 1)
    assert out[2].attempt is None and "Qh5" not in out[2].answer and out[2].fen == START


# terms in one pass


def folded(text, rules):
    for phrase, wording in rules:
        pattern = r"(?<!\w)" + r"\s+".join(map(re.escape, phrase.split())) + r"(?!\w)"
        text = re.sub(pattern, lambda m: wording, text, flags=re.I)  # noqa: B023
    return text


@pytest.mark.parametrize("terms,variants", [(M.TERMS, M.VARIANTS), ({"a": "b c", "b": "", "c d": "a", "d": "- ", "x y": "c"}, {"p q": "a", "q": "c d"}), ({}, {})])
def test_one_pass_equals_the_ordered_fold(spark, terms, variants):
    rng = random.Random(len(terms))
    longest = lambda d: sorted(d, key=lambda k: (-len(k), k))
    rules = [(v, terms[variants[v]]) for v in longest(variants)] + [(t, terms[t]) for t in longest(terms)]
    phrases = [*terms, *variants, *terms.values(), "với", "x"]
    words = [w for p in phrases for w in p.split()]
    texts = ["".join(rng.choice([str, str, str.upper, str.title])(rng.choice(rng.choice([phrases, words]))) + rng.choice([" ", " ", "  ", "\n", ", ", "-", "_"]) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").coalesce(2)
    got = df.select("t", T.enforce_terms(F.col("t"), terms, variants).alias("x"), T.term_violations(F.col("t"), terms, variants).alias("v")).collect()
    named = [(t, t) for t, w in sorted(terms.items()) if t.lower() != w.lower()] + [(v, t) for v, t in sorted(variants.items())]
    for r in got:
        if r.t is None:
            assert r.x is None and r.v is None
            continue
        assert r.x == folded(r.t, rules)
        want = [(t, m, terms[t]) for p, t in named for m in re.findall(r"(?i)(?<!\w)" + r"\s+".join(map(re.escape, p.split())) + r"(?!\w)", r.t)]
        assert [tuple(v) for v in r.v] == want


def test_tokens_of_many_squares_take_linear_time():
    text = "Nf3 " + "e4-e5 d4 " * 4000
    assert len(notation.tokens(text)) == 1 + 4000


def test_prompts_are_built_by_the_caller(spark):
    puzzles = spark.createDataFrame([("p", START, ["e2e4"], "b", "t"), ("q", START, ["d2d4"], "b", "t")], "puzzle_id string, fen string, solution array<string>, rating_bucket string, primary_theme string")
    load = lambda: lambda asked: ["Nước đi: " + a.partition(" plays ")[2] for a in asked]
    build = lambda fen: F.concat(F.lit("white of "), F.substring_index(fen, " ", 1), F.lit(" plays e2e4"))
    got = {r.puzzle_id: (r.predicted, r.correct) for r in answers.puzzle_results(puzzles, load, build=build).collect()}
    assert got == {"p": ("e2e4", True), "q": ("e2e4", False)}
    with pytest.raises(ValueError):
        answers.puzzle_results(puzzles, load, build=build, with_all_facts=True)
