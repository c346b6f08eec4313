import functools
import random

import pytest
from conftest import SF

from corvane import registry
from corvane.operators import evaluate, training

P = pytest.importorskip("public_tokenizers")
pytest.importorskip("tokenizers")
FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
SCHEMA = "id long, messages array<struct<role:string,content:string>>, code string, labels string"


@functools.cache
def vocabulary(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path(name))


def plain(messages, name, most):
    """Two encodings, of the prompt and of the whole."""
    tokenizer = vocabulary(name)
    turns = [f"<|im_start|>{r or ''}\n{c or ''}<|im_end|>\n" for r, c in (m for m in messages or [] if m is not None)]
    if not turns:
        return None
    prompt = "".join(turns[:-1]) + "<|im_start|>assistant\n"
    asked = len(tokenizer.encode(prompt, add_special_tokens=False).ids)
    ids = tokenizer.encode("".join(turns), add_special_tokens=False).ids[:most]
    labels = [-100 if i < asked else x for i, x in enumerate(ids)]
    return None if all(x == -100 for x in labels) else (ids, [1] * len(ids), labels)


def odd_chats():
    rng = random.Random(5)
    bits = ["", " ", "\n", "\n\n", "  two", "word", "Nên đi Nf6.", "e4 e5 \n", "<|endoftext|>", "ééé", "世界", "\t", "don't", "x" * 3000, "🙂"]
    some = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 5)))
    turn = lambda: rng.choice([None, (rng.choice(["system", "user", "assistant", None]), rng.choice([None, some(), some(), some()]))])
    rows = [[("user", some()), ("assistant", some())] for _ in range(150)] + [[turn() for _ in range(rng.randint(0, 5))] for _ in range(150)] + [None, [], [None]]
    return [(i, m, "c", "l") for i, m in enumerate(rows)]


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("most", [1, 12, 2048])
def test_rows_equal_two_plain_encodings(spark, name, most):
    rows = odd_chats()
    got = training.training_rows(spark.createDataFrame(rows, SCHEMA), training.library_file(P.path(name)), most=most, batch=7)
    assert got.columns == ["id", "messages", "code", "input_ids", "attention_mask", "labels"]
    found = {r.id: (r.input_ids, r.attention_mask, r.labels) for r in got.collect()}
    want = {i: w for i, m, *_ in rows if (w := plain(m, name, most)) is not None}
    assert found == want


def test_prompts_at_a_clean_cut_are_not_encoded():
    real, calls = vocabulary(FILES[0]), []

    class Counting:
        normalizer, pre_tokenizer = real.normalizer, real.pre_tokenizer

        def encode_batch(self, texts, **options):
            calls.append(len(texts))
            return real.encode_batch(texts, **options)

    lead = training.LEAD
    prompts = [f"<|im_start|>user\nq{i}<|im_end|>\n{lead}" for i in range(20)]
    texts = [p + (" spaced" if i % 5 == 0 else "plain") for i, p in enumerate(prompts)]
    training.encoded(prompts, texts, Counting())
    assert calls == [20, 4]


def test_no_rows_and_bad_limits(spark):
    load = training.library_file(P.path(FILES[0]))
    assert training.training_rows(spark.createDataFrame([], SCHEMA), load).count() == 0
    with pytest.raises(ValueError):
        training.training_rows(spark.createDataFrame([], SCHEMA), load, most=0)


def test_query_equals_two_plain_encodings(spark):
    import zlib

    import duckdb

    turns = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet' WHERE text IS NOT NULL ORDER BY conv_id, turn").fetchall()
    first = {}
    for conv, _, role, text in turns:
        first.setdefault(conv, {}).setdefault(role, text)
    want = {}
    for conv, of in first.items():
        if of.get("user", "").strip() and of.get("assistant", "").strip():
            row = plain([("system", "S"), ("user", of["user"]), ("assistant", of["assistant"])], FILES[0], 2048)
            if row:
                want[conv] = (len(row[0]), row[2].count(-100), zlib.crc32(",".join(map(str, row[0])).encode()), zlib.crc32(",".join(map(str, row[2])).encode()))
    got = {r.conv_id: (r.n_tokens, r.n_prompt, r.ids_crc32, r.labels_crc32) for r in registry.QUERIES["training_rows"](spark, SF).collect()}
    assert got == want


def test_lengths(spark):
    df = spark.createDataFrame([(300,)] * 500 + [(1900,)] * 10, "n int")
    assert {r.q: r["value"] for r in evaluate.nearest_rank(df, "n").collect()} == {0.5: 300, 0.9: 300, 0.99: 1900, 1.0: 1900}
