"""Operators on records that hold chess positions: normalised questions, puzzles, labels, facts, openings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.chess import udf as K
from corvane.functions import text as T
from corvane.functions.columns import free
from corvane.operators.curate import through_distinct
from corvane.operators.sampling import UNTAGGED, rating_bucket

#: Where a question holds its position and its answer.
FEN = r"in FEN:\s*([1-8rnbqkpRNBQKP/]+ [wb] (?:[KQkq]{1,4}|-) (?:[a-h][36]|-) \d+ \d+)"
LABEL = r"(?i)FINAL_ANSWER:\s*([a-h][1-8][a-h][1-8][qrbn]?)"


def normalise(rows: DataFrame, question: str, *, index: str = "id") -> DataFrame:
    """From (instruction, output, id): id, fen, question, answer, label, and ``reason`` if the row is unusable
    (missing_fen, missing_label, illegal_label, other), else null."""
    found = F.regexp_extract("instruction", FEN, 1)
    label = F.lower(F.try_element_at(F.regexp_extract_all("output", F.lit(LABEL), F.lit(1)), F.lit(-1)))
    df = rows.select(F.col(index).alias("id"), F.when(found != "", found).alias("fen"), T.strip(F.col("output")).alias("answer"), label.alias("label"))
    df = through_distinct(df, "fen", lambda d, c: d.withColumn("valid", K.fen_valid(c)), "valid")
    df = df.withColumn("move", K.read_move("fen", "label"))
    reason = F.when(F.col("fen").isNull(), "missing_fen").when(~F.col("valid"), "other").when(F.col("label").isNull(), "missing_label").when(F.col("move").isNull(), "illegal_label")
    return df.select("id", "fen", F.lit(question).alias("question"), "answer", "label", reason.alias("reason"))


def listed(column: Column) -> Column:
    """Words of a text between white space, without empty ones."""
    return F.filter(F.split(T.strip(F.coalesce(column, F.lit(""))), r"\s+"), lambda x: x != "")


def _alias(rows: DataFrame, *names: str) -> Column:
    """The first of these columns that a frame has, in any case; null if it has none."""
    have = {c.lower(): c for c in reversed(rows.columns)}
    found = next((have[n.lower()] for n in names if n.lower() in have), None)
    return F.col(f"`{found}`") if found else F.lit(None).cast("string")


def _words(rows: DataFrame, name: str) -> Column:
    """A column of words between white space, or of an array, without empty ones."""
    kind = {c.lower(): t for c, t in rows.dtypes}.get(name.lower(), "")
    column = _alias(rows, name)
    if kind.startswith("array"):
        return F.filter(F.coalesce(column.cast("array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    return listed(column)


def puzzles(rows: DataFrame, *, width: int = 400, extra: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """From (PuzzleId or id, FEN, Moves, Rating, Themes; moves and themes as texts or arrays, names in any case): one
    prepared puzzle for each row, or its ``error``. An id that is empty or 0 gives way to the other, then to the FEN.
    ``extra`` columns are kept."""
    df = rows.select(*[c.alias(n) for n, c in (("__id", _alias(rows, "PuzzleId")), ("__id2", _alias(rows, "id")), ("__fen", _alias(rows, "FEN")), ("__moves", _words(rows, "Moves")), ("__themes", F.array_sort(_words(rows, "Themes"))), ("__rating", _alias(rows, "Rating")))], *extra)
    df = df.withColumn("r", K.replay("__fen", "__moves"))
    rating = F.coalesce(F.col("__rating").cast("int"), F.lit(0))
    given = lambda c: F.when(~F.col(c).cast("string").isin("", "0"), F.col(c).cast("string"))
    return df.select(
        F.coalesce(given("__id"), given("__id2"), F.col("__fen")).alias("puzzle_id"), F.col("__fen").alias("setup_fen"), F.try_element_at("__moves", F.lit(1)).alias("opponent_move"), F.col("r.fen").alias("fen"), F.col("r.solution").alias("solution"),
        rating.alias("rating"), rating_bucket(rating, width).alias("rating_bucket"), F.col("__themes").alias("themes"), F.coalesce(F.try_element_at("__themes", F.lit(1)), F.lit(UNTAGGED)).alias("primary_theme"), F.col("r.error").alias("error"), *extra,
    )


def label_reasons(answer: Column, fen: Column, label: Column) -> Column:
    """bad_label if the label is no legal move, label_mismatch if the answer concludes with another; none without label."""
    wanted, said = K.read_move(fen, label), K.last_move(answer, fen)
    blank = F.coalesce(T.strip(label), F.lit("")) == ""
    return F.filter(F.array(F.when(blank, None).when(wanted.isNull(), "bad_label").when(said.isNull() | (said != wanted), "label_mismatch")), lambda r: r.isNotNull())


def with_facts(rows: DataFrame, fen: str = "fen") -> DataFrame:
    """Adds the struct ``facts``, worked out once for each distinct position; null for what is none."""
    known = lambda d: d.withColumn("facts", F.when(F.col("facts.fen").isNotNull(), F.col("facts")))
    return through_distinct(rows, fen, lambda d, c: known(d.withColumn("facts", K.facts(c))), "facts")


#: Openings that are broadcast at most; a longer book is joined by a shuffle.
BOOK_ROWS = 100_000


def _book(book: DataFrame, at: str, name: str) -> DataFrame:
    own = book.select(F.col("epd").alias(at), F.col("opening").alias(name))
    return F.broadcast(own) if own.limit(BOOK_ROWS + 1).count() <= BOOK_ROWS else own


def with_opening(rows: DataFrame, book: DataFrame, epd: str) -> DataFrame:
    """Adds ``opening`` from a book (epd, opening), null without an entry; an ``opening`` that rows have is replaced."""
    at, name = free([*rows.columns, "opening"], "at", "name")
    named = rows.drop("opening").join(_book(book, at, name), F.col(epd) == F.col(at), "left")
    return named.withColumnRenamed(name, "opening").drop(at)


def with_deepest_opening(games: DataFrame, book: DataFrame, key: str, fen: str, moves: str) -> DataFrame:
    """Adds ``opening``: the book's name of the last position that a game reaches and the book has. Games start from
    ``fen`` (the start if null) and are played up to their first illegal move."""
    at, name = free([key, "ply", "epd"], "at", "name")
    plies = games.select(key, F.posexplode(K.reached(fen, moves)).alias("ply", "epd")).join(_book(book, at, name), F.col("epd") == F.col(at))
    return games.drop("opening").join(plies.groupBy(key).agg(F.max_by(name, "ply").alias("opening")), key, "left")


def material(fen: Column) -> Column:
    """White's and black's piece values, from the text of the position alone."""
    board = F.substring_index(fen, " ", 1)
    total = lambda letters: sum(F.regexp_count(board, F.lit(c)) * K.VALUES[c.upper()] for c in letters)
    return F.struct(total("PNBRQ").alias("white"), total("pnbrq").alias("black"))
