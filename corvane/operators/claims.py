"""Checkable claims of Vietnamese texts about a position. All kinds but moves are worked out in columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.chess import udf as K
from corvane.operators.positions import material, with_facts

#: What a claim of each kind says, and names of pieces and colours.
PIECE_ON = r"(?iU)\b(tượng|tốt|hậu|vua|mã|xe)\s+(trắng|đen)?\s*(?:đang\s+)?(?:ở|tại|trên)\s+(?:ô\s+)?([a-h][1-8])\b"
LEAD = r"(?iU)\b(trắng|đen)\s+(?:đang\s+)?(?:hơn|nhiều hơn)\s+(\d+)?\s*(?:điểm\s*)?quân"
EVEN = r"(?iU)(?:lực lượng|quân số|cán cân)[^.]{0,20}cân bằng"
NO_CHECK = r"(?iU)không\s+(?:đang\s+)?bị\s+chiếu"
CHECK = r"(?iU)(?<!không )(?:đang\s+)?bị\s+chiếu"
TURN = r"(?iU)(?:lượt|đến lượt|tới lượt)\s+(?:của\s+)?(trắng|đen)"
PIECES = {"tốt": "p", "mã": "n", "tượng": "b", "xe": "r", "hậu": "q", "vua": "k"}
WHITE = "trắng"


def squares(fen: Column) -> Column:
    """The board of a FEN as 71 characters: ranks from the eighth down, dots for empty squares, bars between ranks."""
    board = F.substring_index(fen, " ", 1)
    for n in range(8, 0, -1):
        board = F.replace(board, F.lit(str(n)), F.lit("." * n))
    return board


def piece_at(board: Column, square: Column) -> Column:
    """The piece on a square (a name such as e4) of ``squares``; a dot without one."""
    file = F.ascii(F.substring(square, 1, 1)) - ord("a")
    return F.substring(board, (8 - F.substring(square, 2, 1).cast("int")) * 9 + file + 1, F.lit(1))


def _found(text: Column, pattern: str, groups: int) -> Column:
    """Matches as structs: ``m`` the whole, ``g1`` … the groups in lower case, empty where a group took no part."""
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in range(groups + 1)]
    names = ["m", *[f"g{i}" for i in range(1, groups + 1)]]
    at = F.sequence(F.lit(0), F.size(parts[0]) - 1)
    each = F.transform(at, lambda i: F.struct(*[(p[i] if n == "m" else F.lower(p[i])).alias(n) for n, p in zip(names, parts)]))
    return F.when(F.size(parts[0]) > 0, each).otherwise(F.array().cast(f"array<struct<{','.join(f'{n}:string' for n in names)}>>"))


def position_claims(text: Column, fen: Column, in_check: Column) -> Column:
    """Array of (kind, text, is_true) of the kinds piece_square, material, in_check and side_to_move."""
    claim = lambda kind, m, true: F.struct(F.lit(kind).alias("kind"), m.alias("text"), true.alias("is_true"))
    board, lead = squares(fen), material(fen)["white"] - material(fen)["black"]
    kinds = F.create_map(*[F.lit(x) for pair in PIECES.items() for x in pair])
    fits = lambda p, colour: (colour == "") | ((p == F.upper(p)) == (colour == WHITE))
    on = F.transform(_found(text, PIECE_ON, 3), lambda x: claim("piece_square", x["m"], (F.lower(piece_at(board, x["g3"])) == kinds[x["g1"]]) & fits(piece_at(board, x["g3"]), x["g2"])))
    own = lambda x: F.when(x["g1"] == WHITE, lead).otherwise(-lead)
    ahead = F.transform(_found(text, LEAD, 2), lambda x: claim("material", x["m"], F.when(x["g2"] == "", own(x) > 0).otherwise(own(x) == x["g2"].try_cast("int"))))
    even = F.transform(_found(text, EVEN, 0), lambda x: claim("material", x["m"], lead == 0))
    denied = F.transform(_found(text, NO_CHECK, 0), lambda x: claim("in_check", x["m"], ~in_check))
    told = F.transform(_found(F.regexp_replace(text, NO_CHECK, "\x01"), CHECK, 0), lambda x: claim("in_check", x["m"], in_check))
    turn = F.transform(_found(text, TURN, 1), lambda x: claim("side_to_move", x["m"], (F.coalesce(F.get(F.split(fen, " "), F.lit(1)), F.lit("w")) == "w") == (x["g1"] == WHITE)))
    return F.concat(on, ahead, even, denied, told, turn)


def with_claims(answers: DataFrame, *, fen: str = "fen", answer: str = "answer", into: str = "claims") -> DataFrame:
    """Adds ``into``: array of (kind, text, is_true). Rows without answer, or whose position is none, are left out.

    Positions are worked out once each; moves are followed through each text's variations.
    """
    known = with_facts(answers.where(F.col(fen).isNotNull() & F.col(answer).isNotNull()), fen).where("facts IS NOT NULL")
    text = F.col(answer)
    told = F.transform(K.move_claims(text, F.col(fen)), lambda x: F.struct(F.lit("move_legal").alias("kind"), x["text"].alias("text"), x["is_true"].alias("is_true")))
    return known.withColumn(into, F.concat(told, position_claims(text, F.col(fen), F.col("facts.in_check")))).drop("facts")


def claims_table(answers: DataFrame, key: str, **names: str) -> DataFrame:
    """A row for each claim: ``key``, kind, text, is_true."""
    into = names.get("into", "claims")
    return with_claims(answers, **names).select(key, F.explode(into).alias("c")).select(key, "c.kind", "c.text", "c.is_true")

