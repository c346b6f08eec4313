"""Vectorised functions over the chess kernel. Put distinct values through them (``curate.through_distinct``)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.chess import notation
from corvane.chess.position import START, Position, name, position, uci

VALUES = {"P": 1, "N": 3, "B": 3, "R": 5, "Q": 9, "K": 0}
_SQUARE = T.StructType([T.StructField("square", T.StringType()), T.StructField("piece", T.StringType())])
_S, _I, _B, _A = T.StringType(), T.IntegerType(), T.BooleanType(), T.ArrayType(T.StringType())
FACTS = T.StructType([T.StructField(n, t) for n, t in [
    ("fen", _S), ("side_to_move", _S), ("legal_moves", _A), ("checks_available", _A), ("captures_available", _A), ("white", _I), ("black", _I), ("hanging", T.ArrayType(_SQUARE)), ("hanging_own", T.ArrayType(_SQUARE)),
    ("in_check", _B), ("is_checkmate", _B), ("is_stalemate", _B), ("epd", _S), ("fullmove_number", _I), ("legal_uci", _A), ("over", _S),
]])
REPLAY = T.StructType([T.StructField("fen", _S), T.StructField("solution", _A), T.StructField("error", _S)])
MASKED = T.StructType([T.StructField("text", _S), T.StructField("mapping", T.MapType(_S, _S))])
TOKENS = T.ArrayType(T.StructType([T.StructField("start", _I), T.StructField("end", _I), T.StructField("text", _S), T.StructField("kind", _S)]))
GUARD = T.StructType([T.StructField("ok", _B), T.StructField("violations", _A), T.StructField("checked", _A)])


def facts_of(fen: str | None) -> tuple | None:
    """What is true of a position, null if the text is none."""
    at = position(fen) if fen else None
    if at is None:
        return None
    legal = at.legal()
    sans = [at.san(m) for m in legal]
    sums = [sum(VALUES[p.upper()] for p in at.board if p != "." and p.isupper() == white) for white in (True, False)]
    loose = [(name(s), p) for s, p in enumerate(at.board) if p not in ".Kk" and at.attackers(not p.isupper(), s) and not at.attackers(p.isupper(), s)]
    check = at.in_check()
    return (
        at.fen(), "white" if at.white else "black", sans, [s for s in sans if s[-1] in "+#"], [s for s, m in zip(sans, legal) if at.captures(m)], *sums, loose, [x for x in loose if x[1].isupper() == at.white],
        check, check and not legal, not check and not legal, at.epd(), at.full, [uci(m) for m in legal], at.over(),
    )


def _struct(kind: T.StructType, rows: list) -> pd.DataFrame:
    return pd.DataFrame([r if r is not None else (None,) * len(kind) for r in rows], columns=kind.names).astype(object)


@F.pandas_udf(FACTS)
def facts(fens: pd.Series) -> pd.DataFrame:
    return _struct(FACTS, [facts_of(f) for f in fens])


@F.pandas_udf(_B)
def fen_valid(fens: pd.Series) -> pd.Series:
    return pd.Series([f is not None and position(f) is not None for f in fens])


@F.pandas_udf(_S)
def read_move(fens: pd.Series, texts: pd.Series) -> pd.Series:
    """The move that a text names on a position, in UCI; null if it is not legal there."""

    def one(fen, text):
        at = position(fen) if fen and text else None
        move = at.read(text) if at else None
        return uci(move) if move else None

    return pd.Series([one(f, t) for f, t in zip(fens, texts)], dtype=object)


@F.pandas_udf(_S)
def last_move(texts: pd.Series, fens: pd.Series) -> pd.Series:
    return pd.Series([notation.last_move(t, f) if t and f else None for t, f in zip(texts, fens)], dtype=object)


@F.pandas_udf(TOKENS)
def find_tokens(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else [x._asdict() for x in notation.tokens(t)] for t in texts], dtype=object)


@F.pandas_udf(TOKENS)
def find_tokens_within(texts: pd.Series, fens: pd.Series, need_context: pd.Series) -> pd.Series:
    """Tokens within the position's variations; without one, or with what is none, by the text alone, where bare pawn moves
    need something sure beside them unless ``need_context`` is false."""
    return pd.Series([None if t is None else [x._asdict() for x in notation.each(t, f if f and position(f) else None, need_context=n is not False)] for t, f, n in zip(texts, fens, need_context.astype(object))], dtype=object)


@F.pandas_udf(MASKED)
def mask(texts: pd.Series, fens: pd.Series) -> pd.DataFrame:
    """Masks within the position's variations; without one, or with what is none, by the text alone."""
    return _struct(MASKED, [None if t is None else notation.mask(t, f if f and position(f) else None) for t, f in zip(texts, fens)])


@F.pandas_udf(_S)
def unmask(texts: pd.Series, mappings: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else notation.unmask(t, dict(m) if m is not None else {}) for t, m in zip(texts, mappings)], dtype=object)


@F.pandas_udf(GUARD)
def guard(texts: pd.Series, fens: pd.Series) -> pd.DataFrame:
    return _struct(GUARD, [notation.guard(t or "", f or "") for t, f in zip(texts, fens)])


@F.pandas_udf(REPLAY)
def replay(fens: pd.Series, moves: pd.Series) -> pd.DataFrame:
    """Plays the first move, the opponent's, and checks that the others follow legally: the position then, the other
    moves, or an error (bad_fen, too_short, illegal)."""

    def one(fen, line):
        at, line = position(fen) if fen else None, [] if line is None else list(line)
        if at is None:
            return None, None, "bad_fen"
        if len(line) < 2:
            return None, None, "too_short"
        first = None
        for text in line:
            move = at.read(text)
            if move is None or uci(move) != text.lower():
                return None, None, "illegal"
            at = at.after(move)
            first = first or at.fen()
        return first, line[1:], None

    return _struct(REPLAY, [one(f, m) for f, m in zip(fens, moves)])


def opening_rows(lines: dict[str, str]) -> list[tuple[str, str, int]]:
    """(epd, name, plies) of openings given as moves in SAN between spaces."""
    out = []
    for line, title in lines.items():
        at = Position.parse(START)
        for text in line.split():
            at = at.after(at.read_san(text))
        out.append((at.epd(), title, len(line.split())))
    return out


def solution_move(fen: Column, solution: Column) -> Column:
    """The first move of an array of moves in SAN or UCI, in UCI; null if it is not legal."""
    return read_move(fen, F.try_element_at(solution, F.lit(1)))


def concluding_move(completion: Column, fen: Column, answer: Column) -> Column:
    """The labelled answer's move, null if it is not legal; without a label the last legal move of the text."""
    return F.when(answer.isNotNull(), read_move(fen, answer)).otherwise(last_move(completion, fen))


def score(move: Column, solution: Column, valid: Column, one_answer: Column, *, correct=1.0, legal=0.1, illegal=-1.0, bonus=0.2) -> Column:
    """A completion's reward: ``illegal`` on what is no position, without the bonus of one answer line."""
    base = F.when(move.isNull(), illegal).when(move == solution, correct).otherwise(legal)
    return F.when(~valid, F.lit(illegal)).otherwise(base + F.when(one_answer, bonus).otherwise(0.0))


_MENTION = re.compile(r"(?:ô|ở|tại|trên)\s+(?:ô\s+)?[a-h][1-8]", re.I)


def each_move_claim(text: str | None, fen: str | None) -> Iterator[dict]:
    """Moves of a text with whether some variation accepts them; squares that are only mentioned are none."""
    root = position(fen) if fen else None
    if not text or root is None:
        return
    lines, named = notation.Variations(root), {i for m in _MENTION.finditer(text) for i in range(*m.span())}
    for t in notation.each(text, need_context=False):
        if t.kind in ("san", "uci") and t.start not in named:
            yield {"text": t.text, "is_true": lines.follow(t.text)}


def move_claims_of(text: str | None, fen: str | None) -> list[dict]:
    """``each_move_claim`` as a list."""
    return list(each_move_claim(text, fen))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("text", _S), T.StructField("is_true", _B)])))
def move_claims(texts: pd.Series, fens: pd.Series) -> pd.Series:
    return pd.Series([move_claims_of(t, f) for t, f in zip(texts, fens)], dtype=object)


@F.pandas_udf(_A)
def illegal_moves(texts: pd.Series, fens: pd.Series) -> pd.Series:
    """Of an array of texts on one position: distinct unambiguous moves that their text's variations do not accept."""
    return pd.Series([notation.illegal_moves([t for t in own if t is not None], f) if own is not None and f else [] for own, f in zip(texts, fens)], dtype=object)


@F.pandas_udf(_A)
def reached(fens: pd.Series, moves: pd.Series) -> pd.Series:
    """EPDs of the position (the start if null) and of each one that the moves lead to, up to the first illegal move."""

    def one(fen, line):
        at = position(fen or START)
        out = [at.epd()] if at else []
        for text in line if line is not None and at else []:
            if (move := at.read(text)) is None:
                break
            at = at.after(move)
            out.append(at.epd())
        return out

    return pd.Series([one(f, m) for f, m in zip(fens, moves)], dtype=object)


@F.pandas_udf(_S)
def clicked(fens: pd.Series, squares: pd.Series, pieces: pd.Series) -> pd.Series:
    """The move, in UCI, from one square to another (such as ``e7e8``) with a promotion piece; a queen if none is given
    and one is needed; null if it is not legal."""

    def one(fen, way, piece):
        at = position(fen) if fen else None
        legal = {uci(m) for m in at.legal()} if at and way else ()
        return next((w for w in ([way + piece] if piece else [way, f"{way}q"]) if w in legal), None)

    return pd.Series([one(*x) for x in zip(fens, squares, pieces)], dtype=object)
