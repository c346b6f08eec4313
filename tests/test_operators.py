import pytest
from pyspark.sql import functions as F

from corvane.chess import udf as K
from corvane.chess.position import START
from corvane.functions import text as T
from corvane.functions.terms import TERMS, VARIANTS
from corvane.chess.openings import OPENINGS
from corvane.functions import engine
from corvane.functions.terms import canonical, term_list
from corvane.operators import answers, claims, curate, evaluate, positions, prompts, reports, sampling, translate, validate
from corvane.sources import records
from corvane.streaming import jobs


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_terms(spark):
    assert one(spark, T.enforce_terms(F.col("t"), TERMS, VARIANTS), t="Rook và hiệp sĩ, PASSED  pawn") == "xe và mã, tốt thông"
    found = one(spark, T.term_violations(F.col("t"), TERMS, VARIANTS), t="a passed pawn, zugzwang, nĩa")
    assert {r.term for r in found} == {"passed pawn", "pawn", "fork"}
    assert one(spark, T.enforce_terms(F.col("t"), TERMS, VARIANTS), t="ghimđ") == "ghimđ"


def test_text_functions(spark):
    assert one(spark, T.longest_english_run(F.col("t")), t="the cat and dog ở đây the cat is big and red now") == 7
    assert one(spark, T.leftover(F.col("t")), t="<M1> <M0> <M1>") == ["<M0>", "<M1>"]
    assert one(spark, T.next_free(F.col("t"), "M"), t="<M4> <M2>") == 5
    assert one(spark, T.answer(F.col("t")), t="x final_answer: e2e4. FINAL_ANSWER: a1a2") == "e2e4"
    assert one(spark, T.without_thoughts(F.col("t")), t=" <think>a\nb</THINK> c\t") == "c"
    assert one(spark, T.has_one_answer(F.col("t")), t="Nước đi: e4 FINAL_ANSWER: e4") is False


@pytest.mark.parametrize("source,output,fault", [("a <M0>", "b", "placeholder"), ("abc", "abc", "untranslated"), ("a" * 300, "b" * 100, "truncated"), ("white white", "quân", "colours"), ("white white", "trắng", None)])
def test_translation_fault(spark, source, output, fault):
    assert one(spark, T.translation_fault(F.col("s"), F.col("o")), s=source, o=output) == fault


def test_gate_falls_back(spark):
    df = spark.createDataFrame([("abc",), ("xyz",)], ["s"])
    out = curate.gated(df, "s", lambda s: s, lambda s, why: F.when(s == "abc", "dịch").otherwise(s), "out").collect()
    assert {(r.s, r.out, r.fault) for r in out} == {("abc", "dịch", None), ("xyz", "xyz", "untranslated")}


def test_rating_bucket(spark):
    assert [one(spark, sampling.rating_bucket(F.col("r")), r=r) for r in (0, 399, 400, -1)] == ["0-399", "0-399", "400-799", "-400--1"]
    with pytest.raises(ValueError):
        sampling.rating_bucket(F.lit(1), 0)


def test_split_is_disjoint_and_balanced(spark):
    df = spark.range(400).select("id", (F.col("id") % 3).alias("a"), (F.col("id") % 2).alias("b"))
    out = sampling.test_then_train(df, ["a", "b"], "id", 60, 120)
    test, train = out.where("split = 'test'"), out.where("split = 'train'")
    assert sampling.leaks(test, train, "id") == 0 and (test.count(), train.count()) == (60, 120)
    assert {r["count"] for r in test.groupBy("a", "b").count().collect()} == {10}


def test_least_filled(spark):
    rows = [(1, "x", ["a", "b"], 1), (2, "x", ["a", "b"], 2), (2, "x", ["a"], 3), (3, "x", ["a"], 4), (4, "y", [], 5)]
    df = spark.createDataFrame(rows, "id int, bucket string, themes array<string>, at int")
    got = {(r.at, r.primary_theme, r.status) for r in sampling.least_filled(df, "bucket", "themes", "id", "at", 1).collect()}
    assert got == {(1, "a", "accepted"), (2, "b", "accepted"), (3, None, "duplicate"), (4, None, "cell_full"), (5, "untagged", "accepted")}


def test_kappa(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (5, 5)], ["a", "b"])
    assert df.agg(evaluate.kappa("a", "b")).first()[0] == 1.0
    assert spark.createDataFrame([(1, 5), (5, 1)], ["a", "b"]).agg(evaluate.kappa("a", "b")).first()[0] < 0
    assert spark.createDataFrame([(3, 3)], ["a", "b"]).agg(evaluate.kappa("a", "b")).first()[0] == 1.0


def test_scores(spark):
    assert [one(spark, evaluate.valid_score(F.col("s")), s=s) for s in ("4.7", "9", "x", "inf", " 3 ")] == [4, None, None, None, 3]


def test_ratings_and_agreement(spark, tmp_path):
    for rater, rows in (("ann", ["s1,5,4", "s2,3,x"]), ("bo", ["s1,4,4", "s2,3,9", "s2,2,1"])):
        (tmp_path / f"{rater}.csv").write_text("﻿sample_id,naturalness,terminology\n" + "\n".join(rows) + "\n", encoding="utf-8")
    scores = records.read_ratings(spark, [str(tmp_path / "ann.csv"), str(tmp_path / "bo.csv")], ["naturalness", "terminology"])
    got = {(r.axis, r.metric, r.who): r.value for r in evaluate.agreement(scores, 2).collect()}
    assert got["naturalness", "mean", "bo"] == 3.0 and got["terminology", "kappa", "all"] == 1.0


def test_normalise(spark):
    ask = f"Best move in FEN: {START}. Answer FINAL_ANSWER: <x>"
    rows = [(1, ask, "so FINAL_ANSWER: e2e5 no FINAL_ANSWER: E2E4"), (2, "none", "FINAL_ANSWER: e2e4"), (3, ask, "nothing"), (4, ask, "FINAL_ANSWER: e2e5"), (5, "in FEN: 8/8 w - - 0 1", "FINAL_ANSWER: e2e4")]
    got = {r.id: (r.label, r.reason) for r in positions.normalise(spark.createDataFrame(rows, ["id", "instruction", "output"]), "q").collect()}
    assert got == {1: ("e2e4", None), 2: ("e2e4", "missing_fen"), 3: (None, "missing_label"), 4: ("e2e5", "illegal_label"), 5: ("e2e4", "other")}


def test_puzzles(spark):
    rows = [("p1", START, "e2e4 e7e5 g1f3", 1234, "mate fork"), ("0", START, "e2e4", None, None), ("p3", START, "e2e4 e2e4", 10, ""), ("p4", "bad", "a b", 10, "x")]
    got = {r.puzzle_id: r for r in positions.puzzles(spark.createDataFrame(rows, "PuzzleId string, FEN string, Moves string, Rating int, Themes string")).collect()}
    assert got["p1"].solution == ["e7e5", "g1f3"] and got["p1"].primary_theme == "fork" and got["p1"].rating_bucket == "1200-1599"
    assert got[START].error == "too_short" and got["p3"].error == "illegal" and got["p4"].error == "bad_fen"


def test_rewards(spark):
    rows = [("FINAL_ANSWER: e2e4", START), ("FINAL_ANSWER: d2d4", START), ("FINAL_ANSWER: e2e5", START), ("I like Nf3 more", START), ("FINAL_ANSWER: e2e4", "bad")]
    df = spark.createDataFrame(rows, ["c", "f"]).withColumn("a", T.answer(F.col("c")))
    df = df.withColumn("m", K.concluding_move(F.col("c"), F.col("f"), F.col("a")))
    got = df.select(K.score(F.col("m"), F.lit("e2e4"), K.fen_valid("f"), T.has_one_answer(F.col("c"))).alias("r")).collect()
    assert [round(r.r, 3) for r in got] == [1.2, 0.3, -0.8, 0.1, -1.0]


def test_labels_and_facts(spark):
    rows = [("chơi 1. e4", "e2e4"), ("chơi 1. e4", "d4"), ("chơi e4", "e2e4"), ("chơi e2e4 hay Nf3", "Nf3"), ("chơi 1. e4", "zz"), ("chơi e4", None), ("chơi e4", " ")]
    df = spark.createDataFrame([(a, START, x) for a, x in rows], "a string, f string, l string")
    # a bare pawn move counts only beside sure notation
    want = [[], ["label_mismatch"], ["label_mismatch"], [], ["bad_label"], [], []]
    assert [r.x for r in df.select(positions.label_reasons(F.col("a"), F.col("f"), F.col("l")).alias("x")).collect()] == want
    r = positions.with_facts(df.select(F.col("f").alias("fen"))).select(prompts.moves_text(F.col("facts.legal_moves"), 2).alias("m"), positions.material(F.col("fen")).alias("w")).first()
    assert r.m == "Nh3, Nf3, ... (tổng 20)" and tuple(r.w) == (39, 39)


@pytest.mark.parametrize("cp,mate,text", [(125, None, "+1.25 tốt theo góc nhìn Trắng (Trắng đang ưu thế)"), (-29, None, "-0.29 tốt theo góc nhìn Trắng (thế cân bằng)"), (-30, None, "-0.30 tốt theo góc nhìn Trắng (Trắng đang bất lợi)"), (5, 3, "Trắng có chiếu hết sau 3 nước"), (5, -2, "Trắng bị chiếu hết sau 2 nước"), (5, 0, "Trắng đã bị chiếu hết"), (None, None, None)])
def test_eval_text(spark, cp, mate, text):
    df = spark.createDataFrame([(cp, mate)], "cp int, mate int")
    assert df.select(prompts.eval_text(F.lit("Trắng"), F.col("cp"), F.col("mate")).alias("x")).first().x == text


MATED = "7k/6Q1/6K1/8/8/8/8/8 b - - 0 1"
HANGING = "4k3/8/8/3n4/8/8/3R4/4K3 w - - 3 9"


def test_facts_prompt_and_states(spark):
    df = positions.with_facts(spark.createDataFrame([(START,), (MATED,), (HANGING,), ("bad",)], "fen string"))
    f = F.col("facts")
    got = {r.fen: r for r in df.select("fen", prompts.facts_text(f, opening=F.lit("Khai"), best=F.lit("e4")).alias("text"), prompts.fallback(f).alias("back"), prompts.status_text(f).alias("status"), prompts.result_text(f).alias("result"), prompts.state(f).alias("state")).collect()}
    lines = got[HANGING].text.split("\n")
    assert lines[1:7] == [f"FEN: {HANGING}", "Lượt đi: Trắng (nước thứ 9)", "Cán cân lực lượng: Trắng 5 - Đen 3 (Trắng hơn 2 điểm quân)", "Đang bị chiếu: không", "Quân bỏ ngỏ: mã Đen ở d5", "Nước ăn quân khả dụng: Rxd5"]
    assert lines[-2:] == ["Khai cuộc: Khai", "Nước tốt nhất theo Stockfish: e4"]
    assert got[MATED].text.endswith("Ván đã kết thúc: Đen bị chiếu hết.") and got["bad"].text is None
    assert got[HANGING].back.split("\n")[1:] == ["- Lượt đi: Trắng.", "- Cán cân lực lượng: Trắng 5 - Đen 3.", "- Đang bị chiếu: không.", "- Quân bỏ ngỏ: n ở d5.", "- Nước chiếu khả dụng: Re2+."]
    assert (got[MATED].status, got[MATED].result) == ("Chiếu hết. Trắng thắng.", "Trắng thắng — chiếu hết") and got[START].result is None and got[START].status == "Lượt Trắng."
    import json

    state = json.loads(got[START].state)
    assert state["legal"]["g1"] == ["h3", "f3"] and state["facts"]["legal_count"] == 20 and state["game_over"] is False and state["result"] is None


def test_prompts(spark):
    df = spark.createDataFrame([([("user", "chào"), ("assistant", "vâng")],), ([],), (None,)], "h array<struct<role:string,content:string>>")
    rows = df.select(prompts.prompt(F.lit("FACTS"), F.lit("hỏi?"), F.col("h")).alias("p"), prompts.messages(F.lit("FACTS"), F.lit("hỏi?"), F.col("h")).alias("m")).collect()
    assert rows[0].p == f"{prompts.SYSTEM}\n\n[LỊCH SỬ HỘI THOẠI]\nNgười dùng: chào\nTrợ lý: vâng\n\nFACTS\n\n[CÂU HỎI]\nhỏi?\n\n[TRẢ LỜI]"
    assert rows[1].p == rows[2].p == f"{prompts.SYSTEM}\n\nFACTS\n\n[CÂU HỎI]\nhỏi?\n\n[TRẢ LỜI]"
    assert [m.role for m in rows[0].m] == ["system", "user", "assistant", "user"] and rows[2].m[-1].content == "FACTS\n\n[CÂU HỎI]\nhỏi?"
    assert one(spark, prompts.puzzle_prompt(F.col("f"), "S"), f="8/8") == "S\n\nFEN: 8/8\nBên đang đi cần tìm nước mạnh nhất. Nước đi nào?\n\n[TRẢ LỜI]\n"
    assert canonical(" ROOK ") == "xe" and term_list().startswith("- back rank mate = chiếu hết hàng cuối\n- bishop = tượng")
    with pytest.raises(KeyError):
        canonical("horse")


def test_claims(spark):
    text = "Mã trắng ở g1. Trắng hơn 3 điểm quân, lực lượng cân bằng. Không đang bị chiếu. Đang bị chiếu. Lượt của trắng. Nên đi e4 rồi Qh5 tới ô e2."
    rows = [(1, START, text), (2, "bad", text), (3, START, None), (4, START, ""), (5, HANGING, "TRẮNG hơn quân; trắng hơn 3 quân; Xe đen ở d2, mã ở d5")]
    got = claims.with_claims(spark.createDataFrame(rows, "id int, fen string, answer string")).select("id", "claims").collect()
    by = {r.id: sorted((c.kind, c.text, c.is_true) for c in r.claims) for r in got}
    assert set(by) == {1, 4, 5} and by[4] == []
    assert by[1] == sorted([("piece_square", "Mã trắng ở g1", True), ("material", "Trắng hơn 3 điểm quân", False), ("material", "lực lượng cân bằng", True), ("in_check", "Không đang bị chiếu", True), ("in_check", "Đang bị chiếu", False), ("side_to_move", "Lượt của trắng", True), ("move_legal", "e4", True), ("move_legal", "Qh5", False)])
    assert by[5] == sorted([("material", "TRẮNG hơn quân", True), ("material", "trắng hơn 3 quân", False), ("piece_square", "Xe đen ở d2", False), ("piece_square", "mã ở d5", True)])


def test_validation_gathers_reasons(spark, tmp_path):
    english = "we are in a big house and it was not far"
    rows = [
        (1, START, "hỏi", "đi 1. e4", "e2e4"), (2, None, "x", english, None), (3, "bad fen", "x", "<M0>", "e2e4"), (4, START, english, "<M0> rồi <F1> rook, Nf6 rồi Qh5", "d4"),
        (5, START, "x", "c4 dxc4 rồi Nf3", "Nf3"), (6, START, None, None, "zz"), (7, START, "x", "đi Nf3 rồi Nf6 rồi Ng1", " "),
    ]
    df = spark.createDataFrame(rows, "id int, fen string, question string, answer string, label string")
    got = {r.id: (list(r.reason), list(r.reason_detail)) for r in validate.validated(df, strict_moves=True).collect()}
    assert {i: r for i, (r, _) in got.items()} == {1: [], 2: ["missing_fen"], 3: ["missing_fen"], 4: ["invalid_move", "label_mismatch", "leftover_placeholder", "english_chunk", "glossary"], 5: ["invalid_move"], 6: ["bad_label"], 7: []}
    assert got[4][1][0] == "illegal: Nf6, Qh5" and got[4][1][2] == "left: <F1>, <M0>" and got[4][1][4] == "rook -> xe"
    assert {r.id: list(r.reason) for r in validate.validated(df).where("id IN (4, 5)").collect()} == {4: ["label_mismatch", "leftover_placeholder", "english_chunk", "glossary"], 5: []}
    both = validate.part(df, str(tmp_path / "clean"), str(tmp_path / "bad"), str(tmp_path / "all"))
    assert both.count() == 7 and sorted(r.id for r in spark.read.parquet(str(tmp_path / "clean")).collect()) == [1, 5, 7]
    assert {r.id for r in spark.read.json(str(tmp_path / "bad")).collect()} == {2, 3, 4, 6}
    text = reports.reasons(evaluate.reason_report(both, "reason"))
    assert "missing_fen" in text and "28.57%" in text


def test_translation_stage(spark):
    rows = [(1, START, "play Nf3 or e4 with the rook", "same"), (2, "bad", "play Nf3", "same"), (3, None, None, "same")]
    df = spark.createDataFrame(rows, "id int, fen string, question string, answer string")
    seen = spark.sparkContext.accumulator(0)

    def upper(texts):
        seen.add(len(texts))
        return [t.lower().replace("<m", "< M").replace("play", "đi") for t in texts]

    out = {r.id: r for r in translate.translated(df, translate.batched(upper)).collect()}
    assert out[1].question == "đi Nf3 or e4 with the xe" and out[2].question == "đi Nf3" and out[3].question is None and out[1].answer == "same"
    assert seen.value == 3 and out[1].fen == START
    assert translate.detected_fields(df) == ["question", "answer"]
    with pytest.raises(ValueError):
        translate.detected_fields(df.select("id"))
    with pytest.raises(Exception, match="returned 0 of"):
        translate.translated(df, translate.batched(lambda texts: [])).collect()
    assert one(spark, translate.hint(F.col("f")), f="truncated").startswith("Dịch ĐẦY ĐỦ")


def test_puzzle_accuracy(spark):
    rows = [("a", START, ["e2e4"], "0-399", "fork"), ("b", START, ["d2d4"], "0-399", None), ("c", START, [], None, "pin"), ("d", "bad", ["e2e4"], "x", "x"), ("e", None, ["e2e4"], "x", "x")]
    df = spark.createDataFrame(rows, "puzzle_id string, fen string, solution array<string>, rating_bucket string, primary_theme string")
    for facts in (False, True):
        got = {r.puzzle_id: (r.theme, r.expected, r.predicted, r.correct, r.legal) for r in answers.puzzle_results(df, answers.echo("FINAL_ANSWER: e4."), with_all_facts=facts).collect()}
        assert got == {"a": ("fork", "e2e4", "e2e4", True, True), "b": ("?", "d2d4", "e2e4", False, True), "c": ("pin", None, "e2e4", False, True)}
    report = answers.accuracy_report(answers.puzzle_results(df, answers.echo("FINAL_ANSWER: e5"), limit=2))
    whole = report.where("slice = 'overall'").first()
    assert (whole.n, whole.hits, whole.legal_rate) == (2, 0, 0.0)
    assert "0/2" in reports.accuracy("echo", report)
    told = answers.generated(df, answers.echo("Lượt của đen. Nf3"), limit=3)
    figures = {r.kind: (r.claims, r.false_claims, r.answers, r.answers_with_error) for r in answers.claims_figures(told).collect()}
    assert figures["answers"] == (6, 3, 3, 3) and figures["side_to_move"] == (3, 3, 3, 3) and figures["move_legal"] == (3, 0, 3, 0)
    with pytest.raises(Exception, match="returned 0 of"):
        answers.generated(df, lambda: lambda asked: []).collect()


def test_openings_by_replay(spark):
    from corvane.chess.udf import opening_rows

    book = spark.createDataFrame([r[:2] for r in opening_rows(OPENINGS)], "epd string, opening string")
    games = spark.createDataFrame([(1, None, ["e4", "e5", "Nf3", "Nc6", "Bb5", "a6"]), (2, HANGING, ["Rxd5"]), (3, None, ["d4", "e1e8"]), (4, None, None)], "id int, fen string, moves array<string>")
    got = {r.id: r.opening for r in positions.with_deepest_opening(games, book, "id", "fen", "moves").collect()}
    assert got == {1: "Khai cuộc Tây Ban Nha (Ruy Lopez)", 2: None, 3: "Khai cuộc tốt hậu (1.d4)", 4: None}


def test_clicked_moves(spark):
    df = spark.createDataFrame([(START, "e2e4", None), (START, "e2e5", None), ("8/P6k/8/8/8/8/8/K7 w - - 0 1", "a7a8", None), ("8/P6k/8/8/8/8/8/K7 w - - 0 1", "a7a8", "n"), ("bad", "e2e4", None)], "f string, w string, p string")
    assert [r.x for r in df.select(K.clicked("f", "w", "p").alias("x")).collect()] == ["e2e4", None, "a7a8q", "a7a8n", None]


def test_engine_settings(spark):
    df = spark.createDataFrame([(500,), (2200,), (2220,), (2400,), (9999,)], "e int")
    e = F.col("e")
    got = [tuple(r) for r in df.select(engine.route_engine(e), engine.skill_for_elo(e), engine.depth_for_elo(e), engine.clamp_elo(e), engine.weak_settings(e)["depth"]).collect()]
    assert got == [("maia", 10, 8, 800, 1), ("maia", 10, 8, 2200, 7), ("stockfish", 10, 8, 2220, 7), ("stockfish", 15, 13, 2400, 7), ("stockfish", 20, 18, 2600, 7)]


def test_balanced_sample(spark):
    rows = [(f"p{i}", i, f"{400 * (i % 3)}-{400 * (i % 3) + 399}", ["a", "b"] if i % 2 else [], "bad_fen" if i % 10 == 0 else None, "old") for i in range(300)]
    df = spark.createDataFrame(rows, "puzzle_id string, at int, rating_bucket string, themes array<string>, error string, primary_theme string")
    sample, tally = sampling.balanced_sample(df, "at", 20, 10, per_cell=5, max_scan=200)
    got = sample.collect()
    assert len(got) == 30 and {r.split for r in got} == {"test", "train"} and max(r.at for r in got) < 200 and all(r.error is None for r in got)
    assert max(r["count"] for r in sample.groupBy("primary_theme", "rating_bucket").count().collect()) <= 5
    n = {r.reason: r.n for r in tally.collect()}
    assert n == {"bad_fen": 20, "cell_full": 200 - 20 - 45} and "cell_full" in reports.tally(45, tally)
    assert sampling.balanced_sample(df, "at", 200, 100)[0].count() == 27


def test_balanced_order_and_form(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" if i % 3 else "", None if i % 2 else "0-399", START, ["e2e4"] if i % 5 else []) for i in range(30)], "id int, primary_theme string, rating_bucket string, fen string, solution array<string>")
    order = [r.id for r in sampling.balanced_order(df, "id", 100).orderBy("rn").collect()]
    assert sorted(order) == list(range(30))
    assert sampling.balanced_order(df, "id", 4).select("rn").distinct().count() == 1
    rl = curate.rl_rows(df, "id", "S", "FEN: %s", limit=10).collect()
    assert len(rl) <= 10 and rl[0].prompt[1].content == f"FEN: {START}" and all(r.solution for r in rl)
    answered = df.withColumn("answer", F.when(F.col("id") != 3, "đáp, \"án\""))
    form = sampling.rating_form(answered, "id", 5)
    assert records.write_form(form, str(tmp_path / "form.csv")) == 5
    raw = (tmp_path / "form.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfsample_id,fen,question,answer,naturalness,terminology,notes") and 'đáp, ""án""'.encode() in raw
    assert sampling.rating_form(answered, "id").count() == 29
    with pytest.raises(ValueError):
        sampling.rating_form(answered.where("id = 3"), "id")


def test_examples_and_dialogue(spark):
    df = spark.createDataFrame([(1, "q", None, "a"), (2, " ", "p", "a"), (3, None, None, "a"), (4, "q", None, " ")], "id int, question string, prompt string, answer string")
    got = curate.examples(df, "id", system="S", limit=2).collect()
    assert [(r.id, r.messages[1].content) for r in got] == [(1, "q"), (2, "p")]
    assert curate.examples(df.select("id", "question"), "id", system="S").count() == 0
    turns = lambda m: spark.createDataFrame([(m,)], "m array<struct<role:string,content:string>>")
    assert len(turns([None, ("user", "x")]).select(curate.dialogue(F.col("m")).alias("x")).first().x) == 1
    with pytest.raises(Exception, match="no message"):
        turns([]).select(curate.dialogue(F.col("m"))).collect()


def test_retry_env_and_preview(spark, tmp_path):
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 7

    assert jobs.retrying(call, 3, 2.0, waits.append) == 7 and waits == [1.0, 2.0]
    with pytest.raises(RuntimeError):
        jobs.retrying(lambda: 1 / 0, 2, 0.0, lambda s: None)
    text = "# c\n\nA=1\nexport B = 'two words' \nC=a=b\n=x\njunk\nD=\n  E=\"q\"\n"
    assert records.parse_env(text) == {"A": "1", "B": "two words", "C": "a=b", "D": "", "E": "q"}
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    assert records.preview(df, df.withColumn("t", F.upper("t")), "id", ["t"], 1) == "id: 1\n  t: a\n  -> A"
    with pytest.raises(ValueError):
        records.read_rows(spark, str(tmp_path), split="test")
    with pytest.raises(ValueError):
        records.read_rows(spark)


def test_nearest_rank_of_ranges(spark):
    df = spark.createDataFrame([(v,) for v in [5, 1, 1, 9, 7, 7, 7, None]], "v int")
    assert {r.q: r.value for r in evaluate.nearest_rank(df, "v", ranges=3).collect()} == {0.5: 7, 0.9: 9, 0.99: 9, 1.0: 9}
    assert evaluate.nearest_rank(df.limit(0), "v").count() == 0


def test_records(spark, tmp_path):
    df = spark.createDataFrame([(1, "é")], "a int, b string")
    assert records.write_clean(df, str(tmp_path / "x.jsonl")) and not records.write_clean(df.where("a > 1"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    records.write_clean(df, str(tmp_path / "p"))
    assert records.read_records(spark, str(tmp_path / "p")).first().b == "é"
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        records.read_records(spark, str(tmp_path / "empty"))
    assert records.read_records(spark, str(tmp_path / "empty"), "a int", strict=False).count() == 0


def test_resumable_job(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    run = lambda: jobs.resumable(spark, src, "id long", lambda d: d.select((F.col("id") * 2).alias("x")), out, mark, files_per_batch=1)
    spark.range(5).coalesce(1).write.parquet(src)
    assert run() == 1 and run() == 0
    spark.range(5, 8).coalesce(1).write.mode("append").parquet(src)
    assert run() == 1
    assert sorted(r.x for r in spark.read.parquet(out).collect()) == [2 * i for i in range(8)]


def test_jobs(spark, tmp_path, capsys):
    import json

    from corvane import jobs as cli

    def file(name, rows):
        (tmp_path / name).write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
        return str(tmp_path / name)

    at = lambda name: str(tmp_path / name)
    run = lambda *args: cli.main(list(args), spark)
    ask = f"Best in FEN: {START}. Say"
    raw = file("raw.jsonl", [{"instruction": ask, "input": "", "output": "vì 1. e4 FINAL_ANSWER: e2e4"}, {"instruction": "?", "input": "", "output": "x"}])
    assert run("normalise", raw, "--target", at("norm")) == 0 and spark.read.json(at("norm")).first().label == "e2e4"
    assert run("normalise", file("none.jsonl", [{"instruction": "?", "input": "", "output": "x"}])) == 1
    assert run("translate", "--target", at("t"), "--checkpoint", at("c")) == 2
    assert run("translate", "--source", at("norm"), "--target", at("t"), "--checkpoint", at("c")) == 0 and spark.read.parquet(at("t")).count() == 1
    assert run("validate", at("t"), "--clean", at("clean"), "--rejected", at("bad")) == 1 and spark.read.json(at("bad")).first().reason == ["english_chunk"]  # nothing was translated
    fine = file("fine.jsonl", [{"fen": START, "question": "đi gì?", "answer": "vì 1. e4", "label": "e2e4"}])
    assert run("validate", fine, "--clean", at("clean"), "--strict-moves") == 0 and spark.read.parquet(at("clean")).count() == 1
    puzzles = file("p.jsonl", [{"PuzzleId": f"p{i}", "FEN": START, "Moves": "e2e4 e7e5", "Rating": 400 * (i % 2), "Themes": "fork"} for i in range(6)] + [{"PuzzleId": "x", "FEN": "bad", "Moves": "a b", "Rating": 1, "Themes": ""}])
    assert run("puzzles", puzzles, "--train", at("train"), "--test", at("test"), "--train-size", "4", "--test-size", "2", "--per-cell", "9") == 0
    assert (spark.read.parquet(at("train")).count(), spark.read.parquet(at("test")).count()) == (4, 2)
    assert run("accuracy", at("test")) == 2 and run("accuracy", at("test"), "--answer", "FINAL_ANSWER: e5", "--target", at("acc"), "--facts") == 0
    assert "2/2" in capsys.readouterr().out
    assert run("claims", at("test"), "--answer", "Nf6", "--target", at("claims")) == 0
    assert run("export-ratings", file("a.jsonl", [{"id": i, "fen": START, "question": "q", "answer": "a"} for i in (1, 2)]), at("form.csv")) == 0
    for who in ("ann", "bo"):
        (tmp_path / f"{who}.csv").write_text("sample_id,naturalness,terminology\n1,4,5\n2,3,3\n")
    assert run("collect-ratings", at("ann.csv"), at("bo.csv"), "--target", at("agree")) == 0 and "ann, bo" in capsys.readouterr().out


def test_clashing_names(spark):
    """Columns that have the names an operator would give its own stay as they are; an older result is replaced."""
    row = ("8/8/8/8/8/8/8/K6k w - - 0 1", "Tốt <M1>", "a", "b", "c", "d", "e", "f", "old")
    df = spark.createDataFrame([row, ("none", *row[1:])], "fen string, answer string, fine string, illegal string, longest string, wrong_terms string, why string, at string, opening string")
    got = {r.fen: r for r in validate.validated(df, label=None).collect()}
    assert got[row[0]].reason == ["leftover_placeholder"] and got["none"].reason == ["missing_fen"]
    assert all(tuple(r)[1:9] == row[1:] for r in got.values())
    assert [tuple(r) for r in answers.playable(df).select(df.columns).collect()] == [row]
    book = spark.createDataFrame([(row[0], "new")], "epd string, opening string")
    named = {r.fen: r for r in positions.with_opening(df, book, "fen").collect()}
    assert named[row[0]].opening == "new" and named["none"].opening is None and named["none"]["at"] == "f"
