"""The operators over the driver's tables, and the same in SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.chess import tables
from corvane.chess.position import START
from corvane.functions import engine
from corvane.functions import text as T
from corvane.operators import answers, curate, evaluate, prompts, sampling, training, translate, validate
from corvane.operators.memory import TranslationMemory
from corvane.operators.memory import key as memory_key
from corvane.sources.ordinals import numbered
from corvane.sources.scratch import Scratch


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def curation_report(spark, d):
    docs = _t(spark, d, "documents").select(F.coalesce("text", F.lit("")).alias("text"))
    why = F.array_compact(F.array(F.when(F.length("text") < 500, "short"), F.when(F.col("text").rlike("[A-Za-z0-9]{32}"), "secret"), F.when(T.longest_english_run(F.col("text")) >= 8, "english_chunk"), F.when(F.size(T.leftover(F.col("text"))) > 0, "leftover_placeholder")))
    return evaluate.reason_report(docs.select(why.alias("reasons")), "reasons")


def english_runs(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.longest_english_run(F.coalesce("text", F.lit(""))).alias("run"))


_STOPS = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_RUNS = f"""
tok AS (SELECT doc_id, w, i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ỹ]+') AS ws FROM documents) x, unnest(ws) WITH ORDINALITY AS u(w, i)),
isl AS (SELECT doc_id, w, regexp_matches(w, '[{T.VIETNAMESE}]') AS f, sum(CASE WHEN regexp_matches(w, '[{T.VIETNAMESE}]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM tok),
runs AS (SELECT doc_id, g, count(*) AS n, sum(CASE WHEN lower(w) IN ({_STOPS}) THEN 1 ELSE 0 END) AS s FROM isl WHERE NOT f GROUP BY doc_id, g),
best AS (SELECT doc_id, max(CASE WHEN s >= 2 THEN n ELSE 0 END)::INT AS run FROM runs GROUP BY doc_id)
"""


def distinct_transform(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "text")
    return curate.through_distinct(docs, "text", lambda x, c: x.withColumn("digest", F.md5(c)), "digest").select("doc_id", "digest")


def price_distribution(spark, d):
    o = _t(spark, d, "orders").select(sampling.rating_bucket(F.col("o_totalprice"), 50000).alias("bucket"))
    return sampling.distribution(o, "bucket").withColumn("pct", F.round("pct", 6))


def round_robin(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "source", "lang")
    return sampling.round_robin(docs, ["source", "lang"], "doc_id", 150).select("doc_id", "rn")


def test_train_split(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "source", "lang")
    return sampling.test_then_train(docs, ["source", "lang"], "doc_id", 100, 300).select("doc_id", "split")


def split_leaks(spark, d):
    both = test_train_split(spark, d)
    test, train = (both.where(F.col("split") == s).select("doc_id") for s in ("test", "train"))
    return test.join(train, "doc_id", "left_semi").agg(F.count("*").alias("leaks"))


def least_filled(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", sampling.rating_bucket(F.col("n_chars"), 1000).alias("bucket"), F.array_sort(F.array("lang", "source")).alias("themes"), F.col("doc_id").alias("at"))
    return sampling.least_filled(docs, "bucket", "themes", "doc_id", "at", 5).select("doc_id", "bucket", "primary_theme", "status")


def filled_with_repeats(spark, d):
    """Every id comes twice, often in two buckets, and is accepted once."""
    docs = _t(spark, d, "documents").select(F.floor(F.col("doc_id") / 2).alias("id"), sampling.rating_bucket(F.col("n_chars"), 1000).alias("bucket"), F.array_sort(F.array("lang", "source")).alias("themes"), F.col("doc_id").alias("at"))
    return sampling.least_filled(docs, "bucket", "themes", "id", "at", 7)


def regenerated_answers(spark, d):
    """A stand-in for a model: digests of the text, then of the last answer; half of the answers pass."""
    docs = _t(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    load = lambda heat: lambda asked: [hashlib.md5(x.encode()).hexdigest() for x in asked]  # noqa: E731
    out = answers.regenerated(docs, load, lambda attempt, last: F.coalesce(last, F.col("text")), lambda x: x < "8", "none")
    return out.select("doc_id", "answer", "attempt", "temperature")


def accuracy_slices(spark, d):
    rows = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
    rows = rows.select("lang", "source", ((F.col("n_chars") > 600).cast("int") == F.col("quality")).alias("correct"), (F.col("toxic") == 0).alias("legal"))
    return evaluate.accuracy(rows, ["lang", "source"]).withColumns({c: F.round(c, 3) for c in ("accuracy", "legal_rate")})


def claims_report(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kinds = {"upper": ("[A-Z]{4,}", "E"), "digits": ("[0-9]{3,}", "7")}


    def found(kind: str, pattern: str, sign: str):
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda x: F.struct(F.lit(kind).alias("kind"), x.contains(sign).alias("is_true")))

    rows = docs.select("doc_id", F.explode(F.concat(*[found(k, *v) for k, v in kinds.items()])).alias("c")).select("doc_id", "c.*")
    return evaluate.claims_report(rows, "doc_id").withColumn("rate", F.round("rate", 6))


def rater_kappa(spark, d):
    e = _t(spark, d, "events").select(F.floor(F.least(F.abs("value"), F.lit(499)) / 100 + 1).cast("int").alias("a"), (F.col("user_id") % 5 + 1).cast("int").alias("b"), "event_type")
    return e.groupBy("event_type").agg(F.round(evaluate.kappa("a", "b"), 6).alias("kappa"), F.round(F.avg((F.abs(F.col("a") - F.col("b")) <= 1).cast("double")), 6).alias("within_one"))


def rater_agreement(spark, d):
    e = _t(spark, d, "events").select(F.col("event_type").alias("axis"), (F.col("event_id") % 3).cast("string").alias("rater"), F.col("user_id").cast("string").alias("sample_id"), (F.col("event_id") % 5 + 1).cast("int").alias("score"), "event_id")
    e = e.groupBy("axis", "rater", "sample_id").agg(F.max_by("score", "event_id").alias("score"))
    return evaluate.agreement(e, 3).withColumn("value", F.round("value", 6))


def length_ranks(spark, d):
    return evaluate.nearest_rank(_t(spark, d, "documents"), "n_chars")


def chat_history(spark, d):
    return curate.history(_t(spark, d, "conversations"), "conv_id", "turn", "role", "text", {"user": "Q", "assistant": "A"}).select("conv_id", F.md5("history").alias("digest"))


def _examples(c):
    q = c.where((F.col("role") == "user")).groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"))
    a = c.where((F.col("role") == "assistant")).groupBy("conv_id").agg(F.min_by("text", "turn").alias("answer"))
    return curate.chat_examples(q.join(a, "conv_id"), "S", question=["question"], answer=["answer"])


def chat_examples(spark, d):
    rows = _examples(_t(spark, d, "conversations"))
    return rows.select("conv_id", F.md5(F.array_join(F.transform("messages", lambda m: F.concat_ws("=", m["role"], m["content"])), "|")).alias("digest"))


def training_rows(spark, d):
    from public_tokenizers import path  # the vocabulary's place on every machine

    rows = training.training_rows(_examples(_t(spark, d, "conversations").where("text IS NOT NULL")), training.library_file(path("byte_bpe_50k.json")))
    digest = lambda c: F.crc32(F.array_join(c, ",").cast("binary"))  # noqa: E731
    learnt = F.size(F.filter("labels", lambda x: x != training.UNLEARNT))
    return rows.select("conv_id", F.size("input_ids").alias("n_tokens"), (F.size("labels") - learnt).alias("n_prompt"), digest("input_ids").alias("ids_crc32"), digest("labels").alias("labels_crc32"))


def first_fine_answer(spark, d):
    c = _t(spark, d, "conversations").where("text IS NOT NULL")
    return curate.first_fine(c, "conv_id", "turn", "text", F.length("text") > 200, "none", 3).select("conv_id", F.md5("answer").alias("digest"))


def shared_with_benchmark(spark, d):
    lead = lambda df, i: df.select(F.col(i).alias(i), F.explode(F.array_distinct(F.split(F.coalesce("text", F.lit("")), "\n"))).alias("line")).where(F.length("line") >= 20)  # noqa: E731
    docs, items = lead(_t(spark, d, "documents"), "doc_id"), lead(_t(spark, d, "benchmark"), "item_id")
    return docs.join(items.select("line").distinct(), "line", "left_semi").groupBy("doc_id").agg(F.count("*").alias("lines"))


def event_fields(spark, d):
    k = F.explode(F.map_entries(F.from_json("props", "map<string,string>"))).alias("e")
    return _t(spark, d, "events").select("event_type", k).groupBy("event_type", F.col("e.key").alias("key")).agg(F.count("*").alias("n"), F.countDistinct("e.value").alias("n_values"))


def term_fold(spark, d):
    text = T.enforce_terms(F.coalesce("text", F.lit("")), _TERMS, _VARIANTS)
    return _t(spark, d, "documents").select("doc_id", F.regexp_count(text, F.lit("zzz")).alias("zzz"), F.regexp_count(text, F.lit("yyy")).alias("yyy"))


def translation_gate(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = curate.gated(docs, "text", lambda s: F.regexp_replace(s, "(?i)(?<![a-z])the(?![a-z])", "những"), lambda s, why: s, "final")  # a stand-in for a translator
    return out.groupBy(F.coalesce("fault", F.lit("kept")).alias("fault")).agg(F.count("*").alias("n"))


def fen_material(spark, d):
    from corvane.operators.positions import material

    fen = F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), "[^rnbqkpRNBQKP]", ""), F.lit(" w"))
    return _t(spark, d, "documents").select("doc_id", material(fen).alias("m")).select("doc_id", "m.white", "m.black")


#: A few English words stand for terms where texts hold no chess.
_TERMS, _VARIANTS = {"that": "zzz", "in the": "yyy", "on": "xxx"}, {"is": "on"}


def record_validation(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.when(F.col("source").isNotNull() & (F.col("n_chars") % 3 > 0), F.lit(START)).alias("fen"), F.col("text").alias("question"), F.col("text").alias("answer"), F.lit(None).cast("string").alias("label"))
    out = validate.validated(docs, terms=_TERMS, variants=_VARIANTS, known=F.col("fen").isNotNull())
    return out.select("doc_id", F.array_join("reason", ",").alias("reasons"), F.md5(F.array_join("reason_detail", "|")).alias("digest"))


def translated_texts(spark, d):
    docs = _t(spark, d, "conversations").select("conv_id", "turn", "text")
    out = translate.translated(docs, lambda t: F.concat(t, F.lit(" #")), ["text"], fen=None, terms={}, variants={})
    return out.select("conv_id", "turn", F.md5("text").alias("digest"))


def staged_translation(spark, d):
    """Stand-ins for a translator: the first pass leaves some texts as they are, the second leaves fewer. The second half
    of the turns meets the memory that the first half's left."""
    turns = _t(spark, d, "conversations").select("conv_id", "turn", "text")
    first = lambda t: F.when(F.length(t) % 4 > 0, F.reverse(t)).otherwise(t)  # noqa: E731
    again = lambda t, why: F.when(F.length(t) % 8 > 0, F.concat(F.lit("> "), F.reverse(t))).otherwise(t)  # noqa: E731
    known = TranslationMemory(spark, Scratch(spark, "memory").path("texts"))
    halves = [translate.translated_with_texts(turns.where(F.col("conv_id") % 2 == k), first, ["text"], retry=again, memory=known, fen=None, terms={}, variants={})[0] for k in (0, 1)]
    fault = known.lookup(known.entries().select("key").distinct()).select("key", "fault")
    out = turns.select("conv_id", "turn", memory_key(F.col("text")).alias("key")).join(fault, "key", "left").drop("key")
    done = halves[0].unionByName(halves[1]).select("conv_id", "turn", F.md5("text").alias("digest"))
    return done.join(out, ["conv_id", "turn"])


def ordinals_of_rows(spark, d):
    rows = numbered(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))
    return rows.select("doc_id", "ordinal")


def facts_prompts(spark, d):
    """Prompts of facts that are made of a document's words."""
    docs = _t(spark, d, "documents").select("doc_id", F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "").alias("w"), "n_chars", "lang")
    pick = lambda rule: F.filter("w", rule)  # noqa: E731
    hanging = F.transform(pick(lambda w: w.rlike("^[nbrqkpNBRQKP]")), lambda w: F.struct(F.lower(F.substring(w, 1, 2)).alias("square"), F.substring(w, 1, 1).alias("piece")))
    facts = F.struct(
        F.concat(F.lit("fen "), F.col("doc_id")).alias("fen"), F.when(F.col("doc_id") % 2 == 0, "white").otherwise("black").alias("side_to_move"), F.col("w").alias("legal_moves"), pick(lambda w: F.length(w) > 12).alias("checks_available"),
        pick(lambda w: w.contains("x")).alias("captures_available"), F.col("n_chars").cast("int").alias("white"), (F.size("w") * 6).alias("black"), hanging.alias("hanging"), (F.col("doc_id") % 3 == 0).alias("in_check"),
        (F.col("doc_id") % 5 == 0).alias("is_checkmate"), (F.col("doc_id") % 7 == 0).alias("is_stalemate"), F.size("w").alias("fullmove_number"),
    )  # fmt: skip
    text = prompts.facts_text(facts, opening=F.col("lang"), centipawns=(F.col("doc_id") % 200 - 100).cast("int"), mate=F.when(F.col("doc_id") % 11 == 0, F.col("doc_id") % 5 - 2).cast("int"))
    return docs.select("doc_id", F.md5(prompts.prompt(text, F.lit("?"))).alias("digest"), F.md5(prompts.fallback(facts)).alias("fallback"))


def balanced_order(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.col("source").alias("primary_theme"), F.when(F.col("n_chars") < 3000, sampling.rating_bucket(F.col("n_chars"), 1000)).alias("rating_bucket"))
    return sampling.balanced_order(docs, "doc_id", 200).select("doc_id", "rn")


def rating_forms(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("question"), F.when(F.col("n_chars") > 500, F.col("text")).alias("answer"))
    return sampling.rating_form(docs, "id").select("sample_id", "question", F.md5("answer").alias("digest"))


def rl_prompts(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("p"), F.col("doc_id"))).alias("fen"), F.when(F.col("doc_id") % 3 > 0, F.array("source")).otherwise(F.array().cast("array<string>")).alias("solution"), F.col("source").alias("primary_theme"), F.col("lang").alias("rating_bucket"))
    return curate.rl_rows(docs, "doc_id", "S", prompts.PUZZLE_USER, limit=300).select("fen", F.md5(F.col("prompt")[1]["content"]).alias("digest"), "primary_theme", "rating_bucket")


def notation_rows(spark, d):
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "[0-9-]", "")
    text = F.regexp_replace(F.regexp_replace(text, r"\bthe\b", "Nf3"), r"\bis\b", "e4")
    rows = tables.token_rows(_t(spark, d, "documents").select("doc_id", text.alias("told")), F.col("told"), outer=True)
    return rows.groupBy("doc_id").agg(F.count("token").alias("n_tokens"), F.count_if(F.col("token.text").startswith("e4")).alias("n_pawn"), F.min("token.start").alias("first"), F.max("token.end").alias("last"))


def engine_levels(spark, d):
    e = F.col("user_id") % 2000 + 700
    rows = _t(spark, d, "events").select(e.alias("elo")).distinct()
    return rows.select("elo", engine.route_engine(F.col("elo")).alias("engine"), engine.skill_for_elo(F.col("elo")).alias("skill"), engine.depth_for_elo(F.col("elo")).alias("depth"), engine.clamp_elo(F.col("elo")).cast("long").alias("clamped"), engine.weak_settings(F.col("elo"))["skill"].alias("weak_skill"))


def placed_by(row):
    """A position with a piece on each rank, by hashes of an id; black is to move and does not attack the white king."""

    def rank(r: int, pieces: str):
        at = F.pmod(F.xxhash64(row, F.lit(r)), F.lit(8 * len(pieces)))
        return F.element_at(F.array(*[F.lit(f"{f or ''}{p}{7 - f or ''}") for p in pieces for f in range(8)]), (at + 1).cast("int"))

    ranks = [rank(8, "k"), *[rank(r, "PNBRQppp") for r in range(7, 2, -1)], rank(2, "PNBRQ"), rank(1, "K")]
    return F.when(row.isNotNull(), F.concat(F.concat_ws("/", *ranks), F.lit(" b - - 0 1")))


def chess_facts(spark, d):
    from corvane.operators.positions import with_facts

    rows = _t(spark, d, "documents").select("doc_id", placed_by(F.col("doc_id")).alias("fen"))
    return with_facts(rows).select("doc_id", F.size("facts.legal_moves").alias("n_legal"), "facts.in_check", "facts.is_checkmate", "facts.is_stalemate", "facts.white", "facts.black")


QUERIES = {f.__name__: f for f in (
    curation_report, english_runs, distinct_transform, price_distribution, round_robin, test_train_split, split_leaks, least_filled, filled_with_repeats, regenerated_answers, accuracy_slices, claims_report, rater_kappa, rater_agreement,
    length_ranks, chat_history, chat_examples, training_rows, first_fine_answer, shared_with_benchmark, event_fields, term_fold, translation_gate, fen_material, chess_facts,
    record_validation, translated_texts, staged_translation, ordinals_of_rows, facts_prompts, balanced_order, rating_forms, rl_prompts, engine_levels, notation_rows,
)}  # fmt: skip
FLAGSHIP = "curation_report"

_RR = "row_number() OVER (PARTITION BY source, lang ORDER BY md5('20240911:' || doc_id::VARCHAR), doc_id) AS rn"
_SPLIT = f"""
a AS (SELECT doc_id, source, lang, {_RR} FROM documents), te AS (SELECT doc_id FROM a ORDER BY rn, source, lang LIMIT 100),
b AS (SELECT doc_id, source, lang, {_RR} FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM te)), tr AS (SELECT doc_id FROM b ORDER BY rn, source, lang LIMIT 300)
"""
#: Java's Unicode word characters, for boundaries that take a character; where matches share one, a second pass finds the rest.
_W = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"


def _fold(text: str) -> str:
    rules = [("is", "xxx"), *sorted(_TERMS.items(), key=lambda kv: (-len(kv[0]), kv[0]))]
    for term, wording in rules:
        pattern = rf"(?i)(^|[^{_W}])" + term.replace(" ", r"\s+") + rf"($|[^{_W}])"
        for _ in range(2):
            text = f"regexp_replace({text}, '{pattern}', '\\1{wording}\\2', 'g')"
    return text


def _english(name: str, rows: str) -> str:
    """Longest English runs (doc_id, run) of ``rows`` (doc_id, text)."""
    return f"""{name}_t AS (SELECT doc_id, w, i FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-zÀ-ỹ]+') AS ws FROM {rows}) x, unnest(ws) WITH ORDINALITY AS u(w, i)),
        {name}_i AS (SELECT doc_id, w, regexp_matches(w, '[{T.VIETNAMESE}]') AS f, sum(CASE WHEN regexp_matches(w, '[{T.VIETNAMESE}]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM {name}_t),
        {name}_r AS (SELECT doc_id, g, count(*) AS n, sum(CASE WHEN lower(w) IN ({_STOPS}) THEN 1 ELSE 0 END) AS s FROM {name}_i WHERE NOT f GROUP BY doc_id, g),
        {name} AS (SELECT doc_id, max(CASE WHEN s >= 2 THEN n ELSE 0 END)::INT AS run FROM {name}_r GROUP BY doc_id)"""


_MOVES = "CASE WHEN len({0}) = 0 THEN 'không có' WHEN len({0}) > {1} THEN array_to_string({0}[1:{1}], ', ') || ', ... (tổng ' || len({0}) || ')' ELSE array_to_string({0}, ', ') END"
_PIECES = "CASE lower(left(x, 1)) WHEN 'p' THEN 'tốt' WHEN 'n' THEN 'mã' WHEN 'b' THEN 'tượng' WHEN 'r' THEN 'xe' WHEN 'q' THEN 'hậu' ELSE 'vua' END || ' ' || CASE WHEN left(x, 1) = upper(left(x, 1)) THEN 'Trắng' ELSE 'Đen' END || ' ở ' || lower(left(x, 2))"
_BUCKET = "(floor({0} / {1}) * {1})::BIGINT"
#: Faults f1 and f2 of a first and a second translation (one, two) of src, with its placeholders and colours.
_FAULTS = ", ".join(f"CASE WHEN ps <> regexp_extract_all({c}, '<[MFN][0-9]+>') THEN 'placeholder' WHEN src = {c} OR {r} >= 8 THEN 'untranslated' WHEN length(src) >= 200 AND length({c}) / length(src) < 0.7 THEN 'truncated' WHEN (nw >= 2 AND NOT contains(lower({c}), 'trắng')) OR (nb >= 2 AND NOT contains(lower({c}), 'đen')) THEN 'colours' END AS {k}" for c, r, k in (("one", "r1", "f1"), ("two", "r2", "f2")))
ORACLE_SQL = {
    "curation_report": f"""WITH {_RUNS}, r AS (SELECT d.doc_id, list_filter([CASE WHEN length(coalesce(text, '')) < 500 THEN 'short' END, CASE WHEN regexp_matches(coalesce(text, ''), '[A-Za-z0-9]{{32}}') THEN 'secret' END,
        CASE WHEN coalesce(run, 0) >= 8 THEN 'english_chunk' END, CASE WHEN regexp_matches(coalesce(text, ''), '<[MFN][0-9]+>') THEN 'leftover_placeholder' END], lambda x: x IS NOT NULL) AS why FROM documents d LEFT JOIN best USING (doc_id)),
        e AS (SELECT unnest(list_concat(['total', CASE WHEN len(why) = 0 THEN 'passed' ELSE 'rejected' END], why)) AS reason FROM r)
        SELECT reason, count(*) AS n, 100.0 * count(*) / (SELECT count(*) FROM documents)::DOUBLE AS pct FROM e GROUP BY reason""",
    "english_runs": f"WITH {_RUNS} SELECT d.doc_id, coalesce(run, 0)::INT AS run FROM documents d LEFT JOIN best USING (doc_id)",
    "distinct_transform": "SELECT doc_id, md5(text) AS digest FROM documents",
    "price_distribution": f"SELECT {_BUCKET.format('o_totalprice', 50000)}::VARCHAR || '-' || ({_BUCKET.format('o_totalprice', 50000)} + 49999)::VARCHAR AS bucket, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS pct FROM orders GROUP BY 1, {_BUCKET.format('o_totalprice', 50000)}",
    "round_robin": f"SELECT doc_id, rn::INT AS rn FROM (SELECT *, {_RR} FROM documents) ORDER BY rn, source, lang LIMIT 150",
    "test_train_split": f"WITH {_SPLIT} SELECT doc_id, 'test' AS split FROM te UNION ALL SELECT doc_id, 'train' FROM tr",
    "split_leaks": f"WITH {_SPLIT} SELECT count(*) AS leaks FROM te JOIN tr USING (doc_id)",
    "accuracy_slices": """WITH r AS (SELECT lang, source, (n_chars > 600)::INT = quality AS c, toxic = 0 AS l FROM labels JOIN documents USING (doc_id)),
        s AS (SELECT 'overall' AS slice, 'all' AS value, c, l FROM r UNION ALL SELECT 'lang', lang, c, l FROM r UNION ALL SELECT 'source', source, c, l FROM r)
        SELECT slice, value, count(*) AS n, sum(c::INT)::BIGINT AS hits, round(round(avg(c::INT), 4), 3) AS accuracy, round(round(avg(l::INT), 4), 3) AS legal_rate FROM s GROUP BY slice, value""",
    "claims_report": """WITH c AS (SELECT doc_id, 'upper' AS kind, contains(x, 'E') AS t FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Z]{4,}')) AS x FROM documents)
        UNION ALL SELECT doc_id, 'digits', contains(x, '7') FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[0-9]{3,}')) AS x FROM documents)),
        e AS (SELECT doc_id, kind, t FROM c UNION ALL SELECT doc_id, 'all', t FROM c), p AS (SELECT kind, doc_id, count(*) AS n, sum((NOT t)::INT) AS b FROM e GROUP BY kind, doc_id)
        SELECT kind, sum(n)::BIGINT AS claims, sum(b)::BIGINT AS false_claims, round(sum(b)::DOUBLE / sum(n)::DOUBLE, 6) AS rate, count(*) AS answers, sum((b > 0)::INT)::BIGINT AS answers_with_error FROM p GROUP BY kind""",
    "rater_kappa": """WITH e AS (SELECT event_type, floor(least(abs(value), 499) / 100 + 1)::INT AS a, (user_id % 5 + 1)::INT AS b FROM events)
        SELECT event_type, round(CASE WHEN sum(a*a) + sum(b*b) - 2.0 * sum(a) * sum(b) / count(*) = 0 THEN 1.0 ELSE 1 - sum((a-b)*(a-b))::DOUBLE / (sum(a*a) + sum(b*b) - 2.0::DOUBLE * sum(a) * sum(b) / count(*)) END, 6) AS kappa,
        round(avg((abs(a - b) <= 1)::INT), 6) AS within_one FROM e GROUP BY event_type""",
    "rater_agreement": """WITH e AS (SELECT event_type AS axis, (event_id % 3)::VARCHAR AS rater, user_id::VARCHAR AS sample_id, arg_max((event_id % 5 + 1)::INT, event_id) AS score FROM events GROUP BY 1, 2, 3),
        k AS (SELECT axis, sample_id FROM e GROUP BY 1, 2 HAVING count(DISTINCT rater) = 3), c AS (SELECT e.* FROM e JOIN k USING (axis, sample_id)),
        p AS (SELECT a.axis, a.rater, b.rater AS r2, count(*) AS n, avg((abs(a.score - b.score) <= 1)::INT) AS w,
              CASE WHEN sum(a.score*a.score) + sum(b.score*b.score) - 2.0::DOUBLE * sum(a.score) * sum(b.score) / count(*) = 0 THEN 1.0 ELSE 1 - sum((a.score-b.score)*(a.score-b.score))::DOUBLE / (sum(a.score*a.score) + sum(b.score*b.score) - 2.0::DOUBLE * sum(a.score) * sum(b.score) / count(*)) END AS q
              FROM c a JOIN c b ON a.axis = b.axis AND a.sample_id = b.sample_id AND a.rater < b.rater GROUP BY 1, 2, 3)
        SELECT axis, 'mean' AS metric, rater AS who, round(avg(score), 6) AS value, count(*) AS n FROM c GROUP BY axis, rater
        UNION ALL SELECT axis, 'kappa', 'all', round(avg(q), 6), max(n) FROM p GROUP BY axis UNION ALL SELECT axis, 'within_one', 'all', round(avg(w), 6), max(n) FROM p GROUP BY axis""",
    "length_ranks": "WITH l AS (SELECT list_sort(list(n_chars)) AS v, count(*) AS n FROM documents) SELECT q::DOUBLE AS q, v[least(n - 1, floor(q * n)::BIGINT) + 1] AS value FROM l, (VALUES (0.5), (0.9), (0.99), (1.0)) AS s(q)",
    "chat_history": "SELECT conv_id, md5(string_agg(CASE role WHEN 'user' THEN 'Q' WHEN 'assistant' THEN 'A' ELSE role END || coalesce(': ' || text, ''), chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id",
    "chat_examples": "WITH q AS (SELECT conv_id, arg_min(text, turn) AS t FROM conversations WHERE role = 'user' GROUP BY 1), a AS (SELECT conv_id, arg_min(text, turn) AS t FROM conversations WHERE role = 'assistant' GROUP BY 1) SELECT conv_id, md5('system=S|user=' || q.t || '|assistant=' || a.t) AS digest FROM q JOIN a USING (conv_id) WHERE trim(q.t) <> '' AND trim(a.t) <> ''",
    "first_fine_answer": "SELECT conv_id, md5(coalesce(arg_min(text, turn) FILTER (WHERE turn < 3 AND length(text) > 200), 'none')) AS digest FROM conversations WHERE text IS NOT NULL GROUP BY conv_id",
    "shared_with_benchmark": "WITH d AS (SELECT doc_id, unnest(list_distinct(string_split(coalesce(text, ''), chr(10)))) AS line FROM documents), b AS (SELECT DISTINCT unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM benchmark) SELECT doc_id, count(*) AS lines FROM d JOIN b USING (line) WHERE length(line) >= 20 GROUP BY doc_id",
    "event_fields": "WITH e AS (SELECT event_type, props, unnest(json_keys(props)) AS key FROM events) SELECT event_type, key, count(*) AS n, count(DISTINCT json_extract_string(props, '$.\"' || key || '\"')) AS n_values FROM e GROUP BY event_type, key",
    "term_fold": f"WITH f AS (SELECT doc_id, {_fold("coalesce(text, '')")} AS t FROM documents) SELECT doc_id, len(regexp_extract_all(t, 'zzz'))::INT AS zzz, len(regexp_extract_all(t, 'yyy'))::INT AS yyy FROM f",
    "translation_gate": rf"""WITH a AS (SELECT doc_id, coalesce(text, '') AS src FROM documents),
        o AS (SELECT doc_id, src, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(src, '(?i)(^|[^a-z])the($|[^a-z])', '\1những\2', 'g'), '(?i)(^|[^a-z])the($|[^a-z])', '\1những\2', 'g'), '(?is)<think>.*?</think>', '', 'g'), '^\s+|\s+$', '', 'g')) AS one,
              regexp_replace(regexp_replace(src, '(?is)<think>.*?</think>', '', 'g'), '^\s+|\s+$', '', 'g') AS two FROM a),
        x1 AS (SELECT doc_id, one AS text FROM o), x2 AS (SELECT doc_id, two AS text FROM o), {_english("e1", "x1")}, {_english("e2", "x2")},
        g AS (SELECT o.*, coalesce(e1.run, 0) AS r1, coalesce(e2.run, 0) AS r2, regexp_extract_all(src, '<[MFN][0-9]+>') AS ps,
              len(regexp_extract_all(src, '(?i)\bwhite\b')) AS nw, len(regexp_extract_all(src, '(?i)\bblack\b')) AS nb FROM o LEFT JOIN e1 USING (doc_id) LEFT JOIN e2 USING (doc_id)),
        f AS (SELECT doc_id, {_FAULTS} FROM g)
        SELECT CASE WHEN f1 IS NULL THEN 'kept' ELSE coalesce(f2, 'kept') END AS fault, count(*) AS n FROM f GROUP BY 1""",
    "least_filled": f"""WITH RECURSIVE r AS (SELECT doc_id, {_BUCKET.format('n_chars', 1000)}::VARCHAR || '-' || ({_BUCKET.format('n_chars', 1000)} + 999)::VARCHAR AS bucket, list_sort([lang, source], 'ASC', 'NULLS LAST') AS themes, row_number() OVER (PARTITION BY {_BUCKET.format('n_chars', 1000)} ORDER BY doc_id) AS k FROM documents),
        s AS (SELECT bucket, 0::BIGINT AS k, MAP {{'': 0}} AS c, NULL::BIGINT AS doc_id, NULL::VARCHAR AS theme, false AS ok FROM (SELECT DISTINCT bucket FROM r)
              UNION ALL SELECT bucket, k, CASE WHEN b.n < 5 THEN map_concat(c, MAP {{b.t: b.n + 1}}) ELSE c END, doc_id, b.t, b.n < 5
              FROM (SELECT r.bucket, r.k, s.c, r.doc_id, list_sort(list_transform(r.themes, lambda t: {{'n': coalesce(s.c[t], 0), 't': t}}))[1] AS b FROM s JOIN r ON r.bucket = s.bucket AND r.k = s.k + 1))
        SELECT doc_id, bucket, CASE WHEN ok THEN theme END AS primary_theme, CASE WHEN ok THEN 'accepted' ELSE 'cell_full' END AS status FROM s WHERE k > 0""",
    "filled_with_repeats": f"""WITH RECURSIVE r AS (SELECT doc_id // 2 AS id, doc_id, {_BUCKET.format('n_chars', 1000)}::VARCHAR || '-' || ({_BUCKET.format('n_chars', 1000)} + 999)::VARCHAR AS bucket, list_sort([lang, source], 'ASC', 'NULLS LAST') AS themes, row_number() OVER (ORDER BY doc_id) AS k FROM documents),
        s AS (SELECT 0::BIGINT AS k, MAP {{'': 0}} AS c, []::BIGINT[] AS taken, NULL::BIGINT AS id, NULL::BIGINT AS doc_id, NULL::VARCHAR AS bucket, NULL::VARCHAR AS theme, NULL::VARCHAR AS status
              UNION ALL SELECT k, CASE WHEN st = 'accepted' THEN map_concat(c, MAP {{bucket || '/' || b.t: b.n + 1}}) ELSE c END, CASE WHEN st = 'accepted' THEN list_append(taken, id) ELSE taken END, id, doc_id, bucket, b.t, st
              FROM (SELECT *, CASE WHEN list_contains(taken, id) THEN 'duplicate' WHEN b.n >= 7 THEN 'cell_full' ELSE 'accepted' END AS st
              FROM (SELECT r.k, s.c, s.taken, r.id, r.doc_id, r.bucket, list_sort(list_transform(r.themes, lambda t: {{'n': coalesce(s.c[r.bucket || '/' || t], 0), 't': t}}))[1] AS b FROM s JOIN r ON r.k = s.k + 1)))
        SELECT bucket, id, doc_id AS at, CASE WHEN status = 'accepted' THEN theme END AS primary_theme, status FROM s WHERE k > 0""",
    "regenerated_answers": """WITH a AS (SELECT doc_id, md5(coalesce(text, '')) AS x, md5(md5(coalesce(text, ''))) AS y, md5(md5(md5(coalesce(text, '')))) AS z FROM documents)
        SELECT doc_id, CASE WHEN x < '8' THEN x WHEN y < '8' THEN y WHEN z < '8' THEN z ELSE 'none' END AS answer, CASE WHEN x < '8' THEN 0 WHEN y < '8' THEN 1 WHEN z < '8' THEN 2 END::INT AS attempt,
               CASE WHEN x < '8' THEN 0.0 WHEN y < '8' THEN 0.1 WHEN z < '8' THEN 0.2 END::DOUBLE AS temperature FROM a""",
    "record_validation": rf"""WITH {_RUNS}, d AS (SELECT doc_id, source IS NOT NULL AND n_chars % 3 > 0 AS ok, coalesce(text, '') AS t FROM documents),
        p AS (SELECT d.*, coalesce(run, 0) AS run, list_sort(list_distinct(regexp_extract_all(t, '<[MFN][0-9]+>'))) AS ph,
              list_concat({", ".join(rf"list_transform(regexp_extract_all(regexp_replace(t, '([^{_W}])', '\1\1', 'g'), '(?i)(?:^|[^{_W}])({term.replace(' ', r'\s+')})(?:$|[^{_W}])', 1), lambda x: regexp_replace(x, '(\s)\s', '\1', 'g') || ' -> {want}')" for term, want in (("in the", "yyy"), ("on", "xxx"), ("that", "zzz"), ("is", "xxx")))}) AS v FROM d LEFT JOIN best USING (doc_id)),
        w AS (SELECT doc_id, ok, list_filter([CASE WHEN len(ph) > 0 THEN {{'r': 'leftover_placeholder', 'd': 'left: ' || array_to_string(ph, ', ')}} END, CASE WHEN run >= 8 THEN {{'r': 'english_chunk', 'd': 'run of ' || run || ' words'}} END,
              CASE WHEN len(v) > 0 THEN {{'r': 'glossary', 'd': array_to_string(list_sort(list_distinct(v)), ', ')}} END], lambda x: x IS NOT NULL) AS g FROM p)
        SELECT doc_id, CASE WHEN ok THEN array_to_string(list_transform(g, lambda x: x.r), ',') ELSE 'missing_fen' END AS reasons, md5(CASE WHEN ok THEN array_to_string(list_transform(g, lambda x: x.d), '|') ELSE 'position: none' END) AS digest FROM w""",
    "translated_texts": "SELECT conv_id, turn, md5(text || ' #') AS digest FROM conversations",
    "staged_translation": rf"""WITH s AS (SELECT DISTINCT text AS src FROM conversations WHERE text IS NOT NULL), t AS (SELECT row_number() OVER (ORDER BY src) AS doc_id, src FROM s),
        o AS (SELECT doc_id, src, {", ".join(rf"regexp_replace(regexp_replace({c}, '(?is)<think>.*?</think>', '', 'g'), '^\s+|\s+$', '', 'g') AS {k}" for k, c in (("one", "CASE WHEN length(src) % 4 > 0 THEN reverse(src) ELSE src END"), ("two", "CASE WHEN length(src) % 8 > 0 THEN '> ' || reverse(src) ELSE src END")))} FROM t),
        x1 AS (SELECT doc_id, one AS text FROM o), x2 AS (SELECT doc_id, two AS text FROM o), {_english("e1", "x1")}, {_english("e2", "x2")},
        g AS (SELECT o.*, coalesce(e1.run, 0) AS r1, coalesce(e2.run, 0) AS r2, regexp_extract_all(src, '<[MFN][0-9]+>') AS ps, len(regexp_extract_all(src, '(?i)\bwhite\b')) AS nw, len(regexp_extract_all(src, '(?i)\bblack\b')) AS nb FROM o LEFT JOIN e1 USING (doc_id) LEFT JOIN e2 USING (doc_id)),
        f AS (SELECT src, one, two, {_FAULTS} FROM g)
        SELECT conv_id, turn, md5(CASE WHEN f1 IS NULL THEN one WHEN f2 IS NULL THEN two ELSE text END) AS digest, CASE WHEN f1 IS NOT NULL THEN f2 END AS fault FROM conversations LEFT JOIN f ON text = src""",
    "ordinals_of_rows": "SELECT doc_id, row_number() OVER () - 1 AS ordinal FROM documents",
    "facts_prompts": rf"""WITH d AS (SELECT doc_id, n_chars, lang, list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	

]+'), lambda w: w <> '') AS w FROM documents),
        f AS (SELECT *, list_filter(w, lambda x: contains(x, 'x')) AS cap, list_filter(w, lambda x: length(x) > 12) AS chk, list_filter(w, lambda x: regexp_matches(x, '^[nbrqkpNBRQKP]')) AS hang, len(w) AS n, len(w) * 6 AS b,
              CASE WHEN doc_id % 2 = 0 THEN 'Trắng' ELSE 'Đen' END AS side, CASE WHEN doc_id % 3 = 0 THEN 'có' ELSE 'không' END AS chk_now, doc_id % 200 - 100 AS cp, CASE WHEN doc_id % 11 = 0 THEN doc_id % 5 - 2 END AS mate FROM d),
        t AS (SELECT doc_id, concat_ws(chr(10), '{prompts.FACTS_HEAD}', 'FEN: fen ' || doc_id, 'Lượt đi: ' || side || ' (nước thứ ' || n || ')',
              'Cán cân lực lượng: Trắng ' || n_chars || ' - Đen ' || b || ' (' || CASE WHEN n_chars = b THEN 'cân bằng' ELSE CASE WHEN n_chars > b THEN 'Trắng' ELSE 'Đen' END || ' hơn ' || abs(n_chars - b) || ' điểm quân' END || ')',
              'Đang bị chiếu: ' || chk_now, 'Quân bỏ ngỏ: ' || CASE WHEN len(hang) = 0 THEN 'không có' ELSE array_to_string(list_transform(hang, lambda x: {_PIECES}), ', ') END,
              'Nước ăn quân khả dụng: ' || {_MOVES.format("cap", 12)}, 'Nước chiếu khả dụng: ' || {_MOVES.format("chk", 12)}, 'Nước đi hợp lệ: ' || {_MOVES.format("w", 20)}, 'Khai cuộc: ' || nullif(lang, ''),
              'Đánh giá của Stockfish: ' || CASE WHEN mate = 0 THEN side || ' đã bị chiếu hết' WHEN mate > 0 THEN side || ' có chiếu hết sau ' || mate || ' nước' WHEN mate < 0 THEN side || ' bị chiếu hết sau ' || abs(mate) || ' nước'
                ELSE printf('%+.2f', cp / 100.0) || ' tốt theo góc nhìn ' || side || ' (' || CASE WHEN abs(cp) < 30 THEN 'thế cân bằng' WHEN cp > 0 THEN side || ' đang ưu thế' ELSE side || ' đang bất lợi' END || ')' END,
              CASE WHEN doc_id % 5 = 0 THEN 'Ván đã kết thúc: ' || side || ' bị chiếu hết.' WHEN doc_id % 7 = 0 THEN 'Ván đã kết thúc: hết nước đi (hòa).' END) AS facts,
              concat_ws(chr(10), '{prompts.SORRY}', '- Lượt đi: ' || side || '.', '- Cán cân lực lượng: Trắng ' || n_chars || ' - Đen ' || b || '.', '- Đang bị chiếu: ' || chk_now || '.',
              CASE WHEN len(hang) > 0 THEN '- Quân bỏ ngỏ: ' || array_to_string(list_transform(hang, lambda x: left(x, 1) || ' ở ' || lower(left(x, 2))), ', ') || '.' END, CASE WHEN len(chk) > 0 THEN '- Nước chiếu khả dụng: ' || array_to_string(chk, ', ') || '.' END) AS back FROM f)
        SELECT doc_id, md5('{prompts.SYSTEM}' || chr(10) || chr(10) || facts || chr(10) || chr(10) || '{prompts.QUESTION}' || chr(10) || '?' || chr(10) || chr(10) || '{prompts.ANSWER}') AS digest, md5(back) AS fallback FROM t""",
    "balanced_order": f"""WITH c AS (SELECT doc_id, coalesce(nullif(source, ''), 'untagged') AS a, CASE WHEN n_chars < 3000 THEN {_BUCKET.format('n_chars', 1000)}::VARCHAR || '-' || ({_BUCKET.format('n_chars', 1000)} + 999)::VARCHAR ELSE '?' END AS b FROM documents),
        r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY md5('20240911:' || doc_id::VARCHAR), doc_id) AS rn FROM c) SELECT doc_id, rn::INT AS rn FROM r ORDER BY rn, a, b LIMIT 200""",
    "rating_forms": """WITH r AS (SELECT *, row_number() OVER (ORDER BY md5('20240911:' || doc_id::VARCHAR), doc_id) AS rn FROM documents WHERE n_chars > 500 AND text IS NOT NULL)
        SELECT CASE WHEN doc_id = 0 THEN (rn - 1)::VARCHAR ELSE doc_id::VARCHAR END AS sample_id, lang AS question, md5(text) AS digest FROM r WHERE rn <= 100""",
    "rl_prompts": """WITH c AS (SELECT *, coalesce(nullif(source, ''), 'untagged') AS a, coalesce(nullif(lang, ''), '?') AS b FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY md5('20240911:' || doc_id::VARCHAR), doc_id) AS rn FROM c),
        l AS (SELECT * FROM r ORDER BY rn, a, b LIMIT 300) SELECT 'p' || doc_id AS fen, md5('FEN: p' || doc_id || chr(10) || 'Bên đang đi cần tìm nước mạnh nhất. Nước đi nào?') AS digest, coalesce(source, '') AS primary_theme, coalesce(lang, '') AS rating_bucket FROM l WHERE doc_id % 4 > 0 AND doc_id % 3 > 0""",
    "engine_levels": "WITH e AS (SELECT DISTINCT user_id % 2000 + 700 AS elo FROM events), u AS (SELECT elo, (greatest(2200, least(2600, elo)) - 2200) / 400.0::DOUBLE AS s, (greatest(800, least(2200, elo)) - 800) / 1400.0::DOUBLE AS w FROM e) SELECT elo, CASE WHEN elo <= 2200 THEN 'maia' ELSE 'stockfish' END AS engine, round_even(10 + s * 10, 0)::INT AS skill, round_even(8 + s * 10, 0)::INT AS depth, greatest(800, least(2600, elo))::BIGINT AS clamped, round_even(w * 10, 0)::INT AS weak_skill FROM u",
    "notation_rows": r"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[0-9-]', '', 'g'), '\bthe\b', 'Nf3', 'g'), '\bis\b', 'e4', 'g') AS t FROM documents),
        b AS (SELECT doc_id, t, regexp_extract_all(t, '(?:Nf3|e4)[+#]?[!?]{0,2}') AS x, contains(t, 'Nf3') AS sure FROM a)
        SELECT doc_id, CASE WHEN sure THEN len(x) ELSE 0 END::BIGINT AS n_tokens, CASE WHEN sure THEN len(list_filter(x, lambda m: starts_with(m, 'e4'))) ELSE 0 END::BIGINT AS n_pawn,
               CASE WHEN sure THEN CASE WHEN strpos(t, 'e4') = 0 THEN strpos(t, 'Nf3') ELSE least(strpos(t, 'Nf3'), strpos(t, 'e4')) END - 1 END::INT AS first,
               CASE WHEN sure THEN length(regexp_extract(t, '(?s)^.*(?:Nf3|e4)[+#]?[!?]{0,2}')) END::INT AS last FROM b""",
    "fen_material": "WITH f AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^rnbqkpRNBQKP]', '', 'g') AS b FROM documents) SELECT doc_id, " + ", ".join("(" + " + ".join(f"{v} * (length(b) - length(replace(b, '{p}', '')))" for p, v in zip(s, (1, 3, 3, 5, 9))) + f")::INT AS {n}" for s, n in (("PNBRQ", "white"), ("pnbrq", "black"))) + " FROM f",
}  # fmt: skip
