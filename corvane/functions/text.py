"""Text functions from columns to columns. Patterns are Unicode-aware; texts in decomposed form should be NFC first."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English function words that mark an untranslated stretch.
STOPWORDS = (
    "the and is of to with that this for are on in it as by be was has not but from would should can will his her their there"
).split()
#: Letters that only Vietnamese text has.
VIETNAMESE = "àáảãạăằắẳẵặâầấẩẫậđèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵÀÁẢÃẠĂẰẮẲẴẶÂẦẤẨẪẬĐÈÉẺẼẸÊỀẾỂỄỆÌÍỈĨỊÒÓỎÕỌÔỒỐỔỖỘƠỜỚỞỠỢÙÚỦŨỤƯỪỨỬỮỰỲÝỶỸỴ"
PLACEHOLDER = r"<[MFN]\d+>"
ANSWER = r"(?iU)(?:FINAL_ANSWER|Nước đi)\s*:\s*(\S+)"
ANSWER_DONE = r"(?iU)(?:FINAL_ANSWER|Nước đi)\s*:\s*\S+\s"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[A-Za-zÀ-ỹ]+"), F.lit(0))


def longest_english_run(text: Column) -> Column:
    """Words in the longest run without a Vietnamese letter that holds two stopwords or more; 0 without one.

    Words with such letters become bars; each stretch between bars is a run."""
    marked = F.translate(F.array_join(words(text), " "), VIETNAMESE, "\x01" * len(VIETNAMESE))  # a class of so many letters is slow
    runs = F.split(F.regexp_replace(marked, r"(?<![^ ])[^ \x01]*+\x01[^ ]*+", "|"), r"\|")
    stops = F.lit(rf"(?i)(?<!\S)(?:{'|'.join(STOPWORDS)})(?!\S)")
    sizes = F.transform(runs, lambda r: F.when(F.regexp_count(r, stops) >= 2, F.regexp_count(r, F.lit(r"\S+"))).otherwise(0))
    return F.coalesce(F.array_max(sizes), F.lit(0))


def placeholders(text: Column) -> Column:
    """All placeholders of a text, in order."""
    return F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))


def leftover(text: Column) -> Column:
    """Distinct placeholders, sorted."""
    return F.array_sort(F.array_distinct(placeholders(text)))


def next_free(text: Column, prefix: str) -> Column:
    """The number after the highest that a placeholder of this prefix has."""
    found = F.regexp_extract_all(text, F.lit(rf"<{prefix}(\d+)>"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(found, lambda n: n.cast("int"))) + 1, F.lit(0))


def _phrase(term: str) -> str:
    """A whole phrase in any case, with any white space between its words."""
    return r"(?iU)(?<!\w)" + r"\s+".join(re.escape(w) for w in term.split()) + r"(?!\w)"


class Rules:
    """Ordered phrases with their replacements, and one pattern that tells which of them may occur in a text.

    The pattern is a trie of all phrases, tried once at each start of a word without consuming it, so matches that
    overlap or lie within each other are all seen. A rule is active if its phrase starts where the trie matched, or if an
    active rule before it puts in a word of its phrase. Rules that are not active cannot match, so only the active ones
    run, in order: the results are those of all rules, run one after another.
    """

    def __init__(self, rules: list[tuple[str, str]]):
        self.phrases, self.wordings = [" ".join(p.split()) for p, _ in rules], [w for _, w in rules]
        named = [{x for x in re.split(r"\W+", p.casefold()) if x} for p in self.phrases]
        puts = [{x for x in re.split(r"\W+", w.casefold()) if x} for w in self.wordings]
        after: list[set[int]] = [set() for _ in rules]
        for i in reversed(range(len(rules))):  # what a rule's wording may bring about, by itself or by later ones
            for j in range(i + 1, len(rules)):
                if not puts[i] or puts[i] & named[j]:
                    after[i] |= {j} | after[j]
        self.after = after

    def trie(self) -> str:
        root: dict = {}
        for p in self.phrases:
            at = root
            for c in p:
                at = at.setdefault(c, {})
            at[""] = {}

        def pattern(at: dict) -> str:
            each = [(r"\s+" if c == " " else re.escape(c)) + pattern(below) for c, below in at.items() if c]
            if not each:
                return ""
            return (each[0] if len(each) == 1 and "" not in at else f"(?:{'|'.join(each)})") + ("?" if "" in at else "")

        return pattern(root)

    def active(self, text: Column, *, chained: bool) -> Column:
        """Numbers of the rules that may match, ascending; ``chained``: as each changes the text for those after it."""
        if not self.phrases:
            return F.when(text.isNotNull(), F.array().cast("array<int>"))
        starts = F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?iU)(?<!\w)(?=({self.trie()})(?!\w))"), F.lit(1)))
        keys: dict[str, set[int]] = {}
        for longest in {p.lower() for p in self.phrases}:  # the trie gives the longest phrase at a start; shorter ones begin it
            own = {i for i, p in enumerate(self.phrases) if longest.startswith(p.lower())}
            keys[longest] = own | {j for i in own for j in self.after[i]} if chained else own
        known = F.create_map(*[x for k, v in keys.items() for x in (F.lit(k), F.array(*map(F.lit, sorted(v))))])
        every = F.array(*[F.lit(i) for i in range(len(self.phrases))])  # for letters whose case folds in an unusual way
        numbers = F.transform(starts, lambda s: F.coalesce(known[F.regexp_replace(F.lower(s), r"(?U)\s+", " ")], every))
        return F.array_sort(F.array_distinct(F.flatten(numbers)))

    def column(self, values: list[str]) -> Column:
        return F.array(*map(F.lit, values))


def enforce_terms(text: Column, terms: dict[str, str], variants: dict[str, str]) -> Column:
    """Replaces variants, then source terms, by the approved wording, longest phrase first; later ones see the
    result of earlier ones. ``terms``: source term to wording; ``variants``: wrong wording to source term."""
    longest = lambda d: sorted(d, key=lambda k: (-len(k), k))
    rules = Rules([(v, terms[variants[v]]) for v in longest(variants)] + [(t, terms[t]) for t in longest(terms)])
    if not rules.phrases:
        return text
    patterns, wordings = rules.column(list(map(_phrase, rules.phrases))), rules.column([w.replace("\\", "\\\\").replace("$", "\\$") for w in rules.wordings])
    return F.aggregate(rules.active(text, chained=True), text, lambda t, i: F.regexp_replace(t, F.get(patterns, i), F.get(wordings, i)))


def term_violations(text: Column, terms: dict[str, str], variants: dict[str, str]) -> Column:
    """Array of (term, found, expected): source terms left in a text, and variants; overlapping phrases all count."""
    named = [(t, t) for t, w in sorted(terms.items()) if t.lower() != w.lower()] + [(v, t) for v, t in sorted(variants.items())]
    if not named:
        return F.when(text.isNotNull(), F.array().cast("array<struct<term:string,found:string,expected:string>>"))
    rules = Rules([(p, terms[t]) for p, t in named])
    patterns, own, wordings = rules.column(list(map(_phrase, rules.phrases))), rules.column([t for _, t in named]), rules.column(rules.wordings)

    def found(i: Column) -> Column:
        each = F.regexp_extract_all(text, F.get(patterns, i), F.lit(0))
        return F.transform(each, lambda x: F.struct(F.get(own, i).alias("term"), x.alias("found"), F.get(wordings, i).alias("expected")))

    return F.flatten(F.transform(rules.active(text, chained=False), found))


def without_thoughts(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""))


def translation_fault(source: Column, output: Column, *, run: int = 8, least: float = 0.7, short: int = 200) -> Column:
    """Why a translation is refused, null if it is not; the first that holds: ``placeholder`` (not the same ones in
    order), ``untranslated``, ``truncated``, ``colours`` (a colour named twice or more lacks its counterpart)."""
    same = F.coalesce(placeholders(source), F.array()) == F.coalesce(placeholders(output), F.array())
    lacks = lambda en, vi: (F.regexp_count(source, F.lit(rf"(?iU)(?<!\w){en}(?!\w)")) >= 2) & ~output.rlike(rf"(?iU)(?<!\w){vi}(?!\w)")
    return (
        F.when(~same, "placeholder")
        .when((source == output) | (longest_english_run(output) >= run), "untranslated")
        .when((F.length(source) >= short) & (F.length(output) / F.length(source) < least), "truncated")
        .when(lacks("white", "trắng") | lacks("black", "đen"), "colours")
    )


def answer(text: Column) -> Column:
    """What the first answer label names, without marks at its ends; null if there is no label."""
    found = F.regexp_extract(text, ANSWER, 1)
    return F.when(found != "", F.regexp_replace(found, r"^[.,;:)]+|[.,;:)]+$", ""))


def has_one_answer(text: Column) -> Column:
    return F.regexp_count(text, F.lit(ANSWER)) == 1


def answer_is_complete(text: Column) -> Column:
    return text.rlike(ANSWER_DONE)


def first_filled(*columns: Column) -> Column:
    """The first that is not blank, as it is."""
    return F.coalesce(*[F.when(strip(c) != "", c) for c in columns])


def message_text(messages: Column) -> Column:
    """The contents of an array of messages, by line."""
    return F.array_join(F.transform(messages, lambda m: m["content"]), "\n")
