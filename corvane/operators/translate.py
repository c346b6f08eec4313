"""Translation of records: notation is masked, each distinct text is translated once, notation and terms put back."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.chess import udf as K
from corvane.functions import terms as terms_module
from corvane.functions import text as T
from corvane.functions.columns import free
from corvane.operators.curate import gated
from corvane.operators.memory import TranslationMemory
from corvane.operators.memory import key as memory_key
from corvane.sources.scratch import Scratch

#: Columns that may hold text, and what is asked for after a refusal.
CANDIDATES = ("question", "answer", "instruction", "input", "output", "prompt", "completion", "text")
HINTS = {
    "placeholder": "Chép lại y hệt mọi ký hiệu dạng <M0>, <F0>, <N0> — đúng số lượng, đúng thứ tự, không thêm không bớt.",
    "untranslated": "Không chép lại tiếng Anh. Chỉ xuất bản dịch tiếng Việt.",
    "truncated": "Dịch ĐẦY ĐỦ từ câu đầu tới câu cuối, không bỏ sót câu hay đoạn nào.",
    "colours": "Dịch đúng màu quân: white = trắng, black = đen. Tuyệt đối không đổi bên.",
}

#: A translator is a column function: from masked texts to their translation, row by row.
Translator = Callable[[Column], Column]


def echo(text: Column) -> Column:
    return text


def batched(translate: Callable[[list[str]], list[str]]) -> Translator:
    """A translator from a function of whole batches; one that returns another number of texts than it got raises."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        given = [t for t in texts if t is not None]
        out = translate(given) if given else []
        if len(out) != len(given):
            raise RuntimeError(f"the translator returned {len(out)} of {len(given)} texts")
        each = iter(out)
        return pd.Series([None if t is None else next(each) for t in texts], dtype=object)

    return of


def detected_fields(rows: DataFrame) -> list[str]:
    """Text columns by name and type; raises ValueError if there is none."""
    kinds = dict(rows.dtypes)
    found = [n for n in CANDIDATES if kinds.get(n) == "string"]
    if not found:
        raise ValueError(f"no text column among {rows.columns}")
    return found


def hint(fault: Column) -> Column:
    """What to ask for after a refusal."""
    return F.create_map(*[F.lit(x) for kv in HINTS.items() for x in kv])[fault]


def asked(text: Column, hint: Column) -> Column:
    """What a translator is asked after a refusal: the hint, then the text."""
    return F.concat(F.lit("DỊCH đoạn dưới sang tiếng Việt. "), hint, F.lit("\n\n"), text)


def translated_with_texts(
    rows: DataFrame, translator: Translator, fields: list[str] | None = None, *, retry: Callable[[Column, Column], Column] | None = None, gate: bool = True, memory: TranslationMemory | None = None,
    fen: str | None = "fen", terms: dict[str, str] | None = None, variants: dict[str, str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``rows`` with each text column translated, and the texts that went to the translator (key, text, done, fault).

    Null texts stay null; rows keep their other columns, whatever their names. Notation is masked within the variations
    of the row's position, if it has one, and by the text alone else; the masked rows are written once. Each distinct
    masked text of all columns that ``memory`` does not know goes through ``translator`` once. With ``gate`` its output
    is checked; refused texts, and no others, go through ``retry`` (of text and reason; by default the translator with
    the reason's hint before the text), and those refused again stay as they were, with the reason as ``fault``. What is
    new is merged into the memory before the results are joined back, unmasked leniently, and the approved terms
    enforced.
    """
    fields = detected_fields(rows) if fields is None else fields
    terms = terms_module.TERMS if terms is None else terms
    variants = terms_module.VARIANTS if variants is None else variants
    retry = retry or (lambda text, why: translator(asked(text, hint(why))))
    scratch = Scratch(rows.sparkSession, "translate")
    at = F.col(f"`{fen}`") if fen and fen in rows.columns else F.lit(None).cast("string")
    masks, keys = ([*names] for names in zip(*[free(rows, f"mask{i}", f"key{i}") for i in range(len(fields))]))
    df = rows
    for m, k, n in zip(masks, keys, fields):
        df = df.withColumn(m, K.mask(F.col(f"`{n}`"), at)).withColumn(k, memory_key(F.col(f"{m}.text")))
    df = scratch.write(df, "masked")
    each = F.array(*[F.struct(F.col(k).alias("key"), F.col(f"{m}.text").alias("text")) for m, k in zip(masks, keys)])
    texts = df.select(F.explode(each).alias("x")).select("x.*").where("key IS NOT NULL").dropDuplicates(["key"])
    known = None
    if memory is not None:
        texts = scratch.write(texts, "texts")
        known = scratch.write(memory.lookup(texts), "known")
        texts = texts.join(known, "key", "left_anti")
    if gate:
        new = gated(texts, "text", translator, retry, "done")
    else:
        new = texts.withColumn("done", translator(F.col("text"))).withColumn("fault", F.lit(None).cast("string"))
    new = scratch.write(new, "new")
    if memory is not None and not new.isEmpty():
        memory.merge(new)
    done = new.select("key", "done") if known is None else new.select("key", "done").unionByName(known.select("key", "done"))
    outs = free([*df.columns], *[f"done{i}" for i in range(len(fields))])
    for k, o in zip(keys, outs):
        df = df.join(done.select(F.col("key").alias(k), F.col("done").alias(o)), k, "left")
    out = {n: T.enforce_terms(K.unmask(F.col(o), F.col(f"{m}.mapping")), terms, variants) for n, o, m in zip(fields, outs, masks)}
    return df.select(*[(out[c] if c in out else F.col(f"`{c}`")).alias(c) for c in rows.columns]), new


def translated(rows: DataFrame, translator: Translator, fields: list[str] | None = None, **options) -> DataFrame:
    """The translated rows of ``translated_with_texts``, whose options it takes; without ``gate`` or ``retry`` whatever
    the translator gives is kept."""
    return translated_with_texts(rows, translator, fields, **{"gate": "retry" in options, **options})[0]


def faults(texts: DataFrame) -> DataFrame:
    """fault and n: how many of the texts that went to the translator stayed as they were, by reason."""
    return texts.where("fault IS NOT NULL").groupBy("fault").agg(F.count("*").alias("n"))
