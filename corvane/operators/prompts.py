"""Prompts and answers in Vietnamese from verified facts of a position. Columns only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of sides and pieces, and the wording of facts, prompts and fallback answers.
SIDES = {"white": "Trắng", "black": "Đen"}
PIECES = {"p": "tốt", "n": "mã", "b": "tượng", "r": "xe", "q": "hậu", "k": "vua"}
NONE, YES, NO = "không có", "có", "không"
SYSTEM = (
    "Bạn là trợ lý cờ vua tiếng Việt.\n\nQuy tắc bắt buộc:\n"
    "1. Khối [SỰ THẬT ĐÃ XÁC MINH] là dữ liệu do python-chess và Stockfish tính ra. Nó luôn đúng. Không được nói bất cứ điều gì mâu thuẫn với nó.\n"
    "2. Chỉ được nhắc tới nước đi có trong danh sách nước đi hợp lệ. Không bịa nước đi.\n"
    "3. Không tự tính lại thế cờ, không tự đoán eval. Cần số liệu nào thì lấy từ khối sự thật; khối đó không có thì nói thẳng là không biết.\n"
    "4. Trả lời bằng tiếng Việt, ngắn gọn, dùng đúng thuật ngữ cờ vua tiếng Việt (đòn đôi, ghim, xiên, đòn mở, chiếu hết hàng cuối, bắt tốt qua đường, nhập thành, zugzwang, sai lầm nghiêm trọng, quân bỏ ngỏ).\n"
    '5. Giữ nguyên ký hiệu nước đi dạng SAN như trong khối sự thật, không dịch sang tiếng Việt (viết Nf3, không viết "Mã f3").'
)
PUZZLE_USER = "FEN: %s\nBên đang đi cần tìm nước mạnh nhất. Nước đi nào?"
PUZZLE_QUESTION = "Bên đang đi cần tìm nước mạnh nhất. Nước đi nào? Giải thích ngắn gọn rồi kết thúc bằng đúng một dòng:\nFINAL_ANSWER: <nước đi>"
HISTORY, QUESTION, ANSWER = "[LỊCH SỬ HỘI THOẠI]", "[CÂU HỎI]", "[TRẢ LỜI]"
SPEAKERS = {"user": "Người dùng", "assistant": "Trợ lý"}
FACTS_HEAD = "[SỰ THẬT ĐÃ XÁC MINH - tính bằng python-chess/Stockfish]"
SORRY = "Tôi chưa đưa ra được lời giải thích đáng tin cho thế cờ này, nên chỉ nêu các dữ kiện đã xác minh:"
ENDINGS = {"checkmate": "chiếu hết", "stalemate": "hết nước đi", "insufficient": "không đủ quân để chiếu hết", "fifty": "luật 50 nước"}
#: Moves listed of a kind, of all legal ones when serving, and of all when every one must be there.
FEW, SOME, ALL = 12, 20, 256


def side_name(side: Column) -> Column:
    return F.when(side == "white", SIDES["white"]).otherwise(SIDES["black"])


def _named(piece: Column) -> Column:
    """A piece letter in words: kind and side."""
    kind = F.create_map(*[F.lit(x) for kv in PIECES.items() for x in kv])[F.lower(piece)]
    return F.concat(kind, F.lit(" "), F.when(piece == F.upper(piece), SIDES["white"]).otherwise(SIDES["black"]))


def hanging_text(hanging: Column) -> Column:
    """An array of (square, piece) as a list in words."""
    each = F.transform(hanging, lambda x: F.concat(_named(x["piece"]), F.lit(" ở "), x["square"]))
    return F.when(F.size(hanging) == 0, NONE).otherwise(F.array_join(each, ", "))


def moves_text(moves: Column, limit: int = FEW) -> Column:
    """The first moves of a list, with their number if it is cut."""
    shown = F.array_join(F.slice(moves, 1, limit), ", ")
    return F.when(F.size(moves) == 0, NONE).when(F.size(moves) > limit, F.concat(shown, F.format_string(", ... (tổng %d)", F.size(moves)))).otherwise(shown)


def material_text(white: Column, black: Column) -> Column:
    leader = F.when(white > black, SIDES["white"]).otherwise(SIDES["black"])
    balance = F.when(white == black, "cân bằng").otherwise(F.format_string("%s hơn %d điểm quân", leader, F.abs(white - black)))
    return F.format_string("Trắng %d - Đen %d (%s)", white, black, balance)


def eval_text(side: Column, centipawns: Column, mate: Column) -> Column:
    """An engine's verdict for the side to move, by its name; null without one. Within 0.30 pawns it is balanced."""
    verdict = F.when(F.abs(centipawns) < 30, F.lit("thế cân bằng")).otherwise(F.concat(side, F.when(centipawns > 0, " đang ưu thế").otherwise(" đang bất lợi")))
    scored = F.concat(F.format_string("%+.2f", centipawns / 100), F.lit(" tốt theo góc nhìn "), side, F.lit(" ("), verdict, F.lit(")"))
    mating = F.when(mate == 0, F.concat(side, F.lit(" đã bị chiếu hết"))).otherwise(F.concat(side, F.when(mate > 0, " có").otherwise(" bị"), F.format_string(" chiếu hết sau %d nước", F.abs(mate))))
    return F.when(mate.isNotNull(), mating).when(centipawns.isNotNull(), scored)



def facts_text(facts: Column, *, limit: int = SOME, opening: Column | None = None, centipawns: Column | None = None, mate: Column | None = None, best: Column | None = None) -> Column:
    """The block of verified facts: nine lines, and one for each of opening, evaluation, best move and ending that is
    there. ``facts`` is the struct of ``positions.with_facts``; null facts give null."""
    f = lambda name: facts[name]
    side, given = side_name(f("side_to_move")), lambda c, kind: F.lit(None).cast(kind) if c is None else c
    filled = lambda c: F.when(c != "", c)
    lines = [
        F.lit(FACTS_HEAD),
        F.concat(F.lit("FEN: "), f("fen")),
        F.format_string("Lượt đi: %s (nước thứ %d)", side, f("fullmove_number")),
        F.concat(F.lit("Cán cân lực lượng: "), material_text(f("white"), f("black"))),
        F.concat(F.lit("Đang bị chiếu: "), F.when(f("in_check"), YES).otherwise(NO)),
        F.concat(F.lit("Quân bỏ ngỏ: "), hanging_text(f("hanging"))),
        F.concat(F.lit("Nước ăn quân khả dụng: "), moves_text(f("captures_available"))),
        F.concat(F.lit("Nước chiếu khả dụng: "), moves_text(f("checks_available"))),
        F.concat(F.lit("Nước đi hợp lệ: "), moves_text(f("legal_moves"), limit)),
        F.concat(F.lit("Khai cuộc: "), filled(given(opening, "string"))),
        F.concat(F.lit("Đánh giá của Stockfish: "), eval_text(side, given(centipawns, "int"), given(mate, "int"))),
        F.concat(F.lit("Nước tốt nhất theo Stockfish: "), filled(given(best, "string"))),
        F.when(f("is_checkmate"), F.format_string("Ván đã kết thúc: %s bị chiếu hết.", side)).when(f("is_stalemate"), F.lit("Ván đã kết thúc: hết nước đi (hòa).")),
    ]
    return F.when(facts.isNotNull(), F.concat_ws("\n", *lines))


def history_text(history: Column) -> Column:
    """An array of (role, content) by line, with the speaker's name; null or empty if there is none."""
    name = lambda role: F.when(role == "user", SPEAKERS["user"]).otherwise(SPEAKERS["assistant"])
    return F.array_join(F.transform(history, lambda t: F.concat(name(t["role"]), F.lit(": "), t["content"])), "\n")


def prompt(block: Column, question: Column, history: Column | None = None) -> Column:
    """System text, history if there is one, the block of facts, question and answer mark, between blank lines."""
    past = F.lit(None).cast("string") if history is None else F.when(F.size(history) > 0, F.concat(F.lit(HISTORY + "\n"), history_text(history)))
    return F.concat_ws("\n\n", F.lit(SYSTEM), past, block, F.concat(F.lit(QUESTION + "\n"), question), F.lit(ANSWER))


def messages(block: Column, question: Column, history: Column | None = None) -> Column:
    """The same as an array of (role, content): system, history, and the facts with the question."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    past = [] if history is None else [F.transform(F.coalesce(history, F.array().cast("array<struct<role:string,content:string>>")), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))]
    return F.concat(F.array(turn("system", F.lit(SYSTEM))), *past, F.array(turn("user", F.concat(block, F.lit(f"\n\n{QUESTION}\n"), question))))


def fallback(facts: Column, best: Column | None = None) -> Column:
    """An answer of facts alone, for when no other can be trusted."""
    line = lambda head, body: F.concat(F.lit(f"- {head}: "), body, F.lit("."))
    named = F.array_join(F.transform(facts["hanging"], lambda x: F.concat(x["piece"], F.lit(" ở "), x["square"])), ", ")
    return F.concat_ws(
        "\n", F.lit(SORRY), line("Lượt đi", side_name(facts["side_to_move"])), line("Cán cân lực lượng", F.format_string("Trắng %d - Đen %d", facts["white"], facts["black"])),
        line("Đang bị chiếu", F.when(facts["in_check"], YES).otherwise(NO)), F.when(F.size(facts["hanging"]) > 0, line("Quân bỏ ngỏ", named)),
        F.when(F.size(facts["checks_available"]) > 0, line("Nước chiếu khả dụng", F.array_join(facts["checks_available"], ", "))),
        F.lit(None) if best is None else F.when(best != "", line("Nước tốt nhất theo Stockfish", best)),
    )


def puzzle_prompt(fen: Column, system: str) -> Column:
    """The question for the strongest move from the bare position, ready for the answer."""
    return F.concat(F.lit(system + "\n\n"), F.format_string(PUZZLE_USER, fen), F.lit(f"\n\n{ANSWER}\n"))


def facts_prompt(facts: Column) -> Column:
    """The same question after all facts, of which no engine's verdict is one."""
    return prompt(facts_text(facts, limit=ALL), F.lit(PUZZLE_QUESTION))


def status_text(facts: Column) -> Column:
    """How a game stands, in a sentence."""
    side = side_name(facts["side_to_move"])
    other = F.when(facts["side_to_move"] == "white", SIDES["black"]).otherwise(SIDES["white"])
    running = F.concat(F.lit("Lượt "), side, F.when(facts["in_check"], " (đang bị chiếu)").otherwise(""), F.lit("."))
    ended = F.when(facts["over"] == "checkmate", F.concat(F.lit("Chiếu hết. "), other, F.lit(" thắng."))).when(facts["over"] == "stalemate", "Hết nước đi. Hòa.").when(facts["over"] == "insufficient", "Không đủ lực chiếu hết. Hòa.")
    return F.coalesce(ended, running)


def result_text(facts: Column) -> Column:
    """Who won and why; null while the game goes on. Draws by repetition need the game's moves and are not seen."""
    why = F.create_map(*[F.lit(x) for kv in ENDINGS.items() for x in kv])[facts["over"]]
    other = F.when(facts["side_to_move"] == "white", SIDES["black"]).otherwise(SIDES["white"])
    return F.when(facts["over"] == "checkmate", F.concat(other, F.lit(" thắng — "), why)).when(facts["over"] != "", F.concat(F.lit("Hoà — "), why))


def legal_map(moves: Column) -> Column:
    """Legal moves in UCI as a map from each square to the squares they lead to, in their order, repeated for each
    promotion."""
    froms = F.array_distinct(F.transform(moves, lambda m: F.substring(m, 1, 2)))
    to = lambda s: F.transform(F.filter(moves, lambda m: m.startswith(s)), lambda m: F.substring(m, 3, 2))
    return F.map_from_arrays(froms, F.transform(froms, to))


def state(facts: Column, *, opening: Column | None = None, last: Column | None = None) -> Column:
    """What a board view shows, as JSON."""
    null = F.lit(None).cast("string")
    payload = F.struct(
        side_name(facts["side_to_move"]).alias("side_to_move"), F.struct(facts["white"].alias("white"), facts["black"].alias("black")).alias("material"), (facts["white"] - facts["black"]).alias("material_diff"),
        *[facts[n].alias(n) for n in ("in_check", "hanging", "checks_available", "captures_available")], F.size(facts["legal_moves"]).alias("legal_count"), (null if opening is None else opening).alias("opening"),
        *[facts[n].alias(n) for n in ("is_checkmate", "is_stalemate")],
    )
    whole = F.struct(
        facts["fen"].alias("fen"), facts["side_to_move"].alias("turn"), side_name(facts["side_to_move"]).alias("turn_vi"), facts["fullmove_number"].alias("move_number"), legal_map(facts["legal_uci"]).alias("legal"),
        (facts["over"] != "").alias("game_over"), result_text(facts).alias("result"), (null if last is None else last).alias("last_move"), payload.alias("facts"), facts_text(facts, opening=opening).alias("facts_block"),
    )
    return F.to_json(whole, {"ignoreNullFields": "false"})
