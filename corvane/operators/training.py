"""Training rows from chats: token ids, and labels that teach the last message only."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.columns import free

#: What a turn looks like, by format string of role and content, and what asks for the next answer.
TURN, LEAD = "<|im_start|>%s\n%s<|im_end|>\n", "<|im_start|>assistant\n"
#: Fixed value: the label of a token that is not learnt.
UNLEARNT = -100


def chat_text(messages: Column, turn: str = TURN) -> Column:
    """An array of (role, content) as one text. Null messages are passed over, null contents are empty."""
    there = F.filter(messages, lambda m: m.isNotNull())
    return F.array_join(F.transform(there, lambda m: F.format_string(turn, F.coalesce(m["role"], F.lit("")), F.coalesce(m["content"], F.lit("")))), "")


def library_file(path: str) -> Callable[[], object]:
    """Loads a vocabulary of the tokenizers library from a file that every executor has; special strings in texts are ordinary
    tokens' names, as in a chat template."""

    def load():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    return load


def _prefix_alone(tokenizer) -> bool:
    """Whether a text's ids up to a clean cut are those of its first part alone: byte-level vocabularies that change no
    text before they cut it."""
    return tokenizer.normalizer is None and type(tokenizer.pre_tokenizer).__name__ == "ByteLevel"


def _clean(text: str, cut: int) -> bool:
    """Whether no piece of a byte-level vocabulary reaches over a cut: one new line between what is not white space."""
    return 2 <= cut < len(text) and text[cut - 1] == "\n" and not text[cut - 2].isspace() and not text[cut].isspace()


def encoded(prompts: list[str], texts: list[str], tokenizer) -> tuple[list[list[int]], list[int]]:
    """The ids of ``texts``, and how many ids each prompt has by itself.

    A text is encoded once where it starts with its prompt and the cut between them is clean: the ids that end there are
    then the prompt's. Only the other prompts are encoded too.
    """
    found = tokenizer.encode_batch(texts, add_special_tokens=False)
    counts: list[int | None] = [None] * len(texts)
    if _prefix_alone(tokenizer):
        for i, (p, t, e) in enumerate(zip(prompts, texts, found)):
            if t.startswith(p) and _clean(t, len(p)):
                n = sum(end <= len(p) for _, end in e.offsets)
                if n < len(e.offsets) and e.offsets[n][0] >= len(p):
                    counts[i] = n
    rest = [i for i, n in enumerate(counts) if n is None]
    for i, e in zip(rest, tokenizer.encode_batch([prompts[i] for i in rest], add_special_tokens=False)):
        counts[i] = len(e.ids)
    return [e.ids for e in found], counts


def training_rows(df: DataFrame, load: Callable[[], object], *, messages: str = "messages", most: int = 2048, turn: str = TURN, lead: str = LEAD, batch: int = 256) -> DataFrame:
    """Adds ``input_ids``, ``attention_mask`` and ``labels``, arrays of one length up to ``most``; columns of these names
    are replaced.

    The ids are those of all messages as one text. The labels are the ids, but ``UNLEARNT`` for as many as the messages
    before the last, with ``lead`` behind them, have by themselves. Rows of which nothing would be learnt are left out:
    without messages, or with a prompt that fills ``most``. ``load`` makes the tokenizer once a task.
    """
    if most < 1:
        raise ValueError("most is a number of tokens")

    @F.pandas_udf("struct<ids:array<int>,asked:int>")
    def encode(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        tokenizer = None
        for prompts, texts in parts:
            tokenizer = tokenizer or load()
            ids, asked = [], []
            for i in range(0, len(texts), batch):
                a, b = encoded(prompts[i : i + batch].tolist(), texts[i : i + batch].tolist(), tokenizer)
                ids, asked = ids + a, asked + b
            yield pd.DataFrame({"ids": ids, "asked": asked})

    outs = ("input_ids", "attention_mask", "labels")
    own = [c for c in df.columns if c.lower() not in outs]
    (code,) = free(df, "code")
    there = F.filter(F.col(f"`{messages}`"), lambda m: m.isNotNull())
    n = F.coalesce(F.size(there), F.lit(0))
    before = chat_text(F.slice(there, 1, F.greatest(n - 1, F.lit(0))), turn)
    rows = df.where(n > 0).withColumn(code, encode.asNondeterministic()(F.concat(before, F.lit(lead)), chat_text(there, turn)))  # never encoded twice
    rows = rows.where((F.col(f"{code}.asked") < F.size(f"{code}.ids")) & (F.col(f"{code}.asked") < most))
    ids = F.slice(F.col(f"{code}.ids"), 1, most)
    return rows.select(
        *[F.col(f"`{c}`") for c in own], ids.alias("input_ids"), F.array_repeat(F.lit(1), F.size(ids)).alias("attention_mask"),
        F.transform(ids, lambda x, i: F.when(i < F.col(f"{code}.asked"), F.lit(UNLEARNT)).otherwise(x)).alias("labels"),
    )
