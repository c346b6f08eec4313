"""Sessions of commands and questions as a stream: each has a position and a history, kept as typed state by session."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corvane.chess.position import START, Position, position, uci
from corvane.operators.prompts import SIDES

#: Commands by what they do, and what is replied.
COMMANDS = {"/thoat": "leave", "/quit": "leave", "/exit": "leave", "/giup": "help", "/help": "help", "/fen": "show", "/moi": "new", "/new": "new", "/di": "play", "/bot": "reply"}
HELP = """Lệnh:
  /di <nước>   đi một nước (SAN hoặc UCI), ví dụ: /di e4
  /bot         để đối thủ AI đi một nước
  /fen         in FEN và bàn cờ hiện tại
  /moi [fen]   ván mới (có thể kèm FEN)
  /giup        in trợ giúp này
  /thoat       thoát
Gõ bất cứ thứ gì khác để hỏi trợ lý về thế cờ."""
NO_MOVE, NO_FEN, NO_OPPONENT = "%s không phải nước đi hợp lệ ở thế này", "%s không phải FEN hợp lệ", "phiên này không có đối thủ AI"
PLAYED, ANSWERED, FRESH, WRONG, UNKNOWN = "Bạn đi %s. %s", "Máy đi %s. %s", "Ván mới.\n%s", "Lỗi: %s", "Không biết lệnh %s. Gõ /giup để xem danh sách."
OVER = {"checkmate": "Chiếu hết. %s thắng.", "stalemate": "Hết nước đi. Hòa.", "insufficient": "Không đủ lực chiếu hết. Hòa."}
TURN, IN_CHECK = "Lượt %s%s.", " (đang bị chiếu)"
REPLIES = "session string, at long, line string, reply string, fen string, ended boolean"

#: ``answer(fen, question, history)`` with history as (role, content); ``opponent(fen)`` gives a move.
Answer = Callable[[str, str, list[tuple[str, str]]], str]
Opponent = Callable[[str], str]


def status(at: Position) -> str:
    """How a game stands, in a sentence."""
    side, other = (SIDES["white"], SIDES["black"]) if at.white else (SIDES["black"], SIDES["white"])
    end = OVER.get(at.over())
    if end is None:
        return TURN % (side, IN_CHECK if at.in_check() else "")
    return end % other if "%s" in end else end


def board(at: Position) -> str:
    """Eight lines of a board from the eighth rank down, dots for empty squares."""
    ranks = at.placement().split("/")
    return "\n".join(" ".join("".join("." * int(c) if c.isdigit() else c for c in rank)) for rank in ranks)


def replied(line: str, fen: str, history: list[tuple[str, str]], answer: Answer, opponent: Opponent | None) -> tuple[str, str, list[tuple[str, str]] | None, bool]:
    """The reply to a line, the position after it, the turns it adds (None: history ends) and whether the session ends."""
    at = position(fen)
    if not line.startswith("/"):
        text = answer(fen, line, history)
        return text, fen, [("user", line), ("assistant", text)], False
    word, _, argument = line.partition(" ")
    what, argument = COMMANDS.get(word), argument.strip()
    if what == "leave":
        return "", fen, [], True
    if what == "help":
        return HELP, fen, [], False
    if what == "show":
        return f"{board(at)}\nFEN: {at.fen()}\n{status(at)}", fen, [], False
    if what == "new":
        new = position(argument or START)
        return (WRONG % (NO_FEN % repr(argument)), fen, [], False) if new is None else (FRESH % status(new), new.fen(), None, False)
    if what is None:
        return UNKNOWN % repr(word), fen, [], False
    if what == "reply" and opponent is None:
        return WRONG % NO_OPPONENT, fen, [], False
    text = argument if what == "play" else opponent(fen)
    if (move := at.read(text)) is None:
        return WRONG % (NO_MOVE % repr(text)), fen, [], False
    after = at.after(move)
    return (PLAYED if what == "play" else ANSWERED) % (uci(move), status(after)), after.fen(), [], False


class _Session(StatefulProcessor):
    """State: the position, whether the session has ended, and the turns so far. An idle session's state goes by a timer."""

    def __init__(self, answer: Callable[[], Answer], opponent: Callable[[], Opponent] | None, idle: int):
        self.load_answer, self.load_opponent, self.idle = answer, opponent, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.game = handle.getValueState("game", "fen string, ended boolean")
        self.turns = handle.getListState("turns", "role string, content string")
        self.answer, self.opponent = None, None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.answer is None:
            self.answer, self.opponent = self.load_answer(), self.load_opponent and self.load_opponent()
        fen, ended = self.game.get() if self.game.exists() else (START, False)
        history = [tuple(t) for t in self.turns.get()]
        kept, out, fresh = len(history), [], False
        lines = pd.concat(list(rows))[["at", "line"]].sort_values("at", kind="stable")  # one session's lines of one batch
        for at, line in zip(lines["at"].tolist(), lines["line"].tolist()):
            line = (line or "").strip()
            if ended or not line:
                continue
            reply, fen, more, ended = replied(line, fen, history, self.answer, self.opponent)
            if more is None:
                history, kept, fresh = [], 0, True
            history = history + (more or [])
            out.append((key[0], at, line, reply, fen, ended))
        self.game.update((fen, ended))
        if ended:
            self.turns.clear()
        elif fresh:
            self.turns.put(history) if history else self.turns.clear()
        elif len(history) > kept:
            self.turns.appendList(history[kept:])
        if self.idle:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        if out:
            yield pd.DataFrame(out, columns=["session", "at", "line", "reply", "fen", "ended"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.game.clear()
        self.turns.clear()
        yield from ()

    def close(self) -> None:
        pass


def sessions(lines: DataFrame, answer: Callable[[], Answer], opponent: Callable[[], Opponent] | None = None, *, session: str = "session", at: str = "at", line: str = "line", idle: int = 0) -> DataFrame:
    """A reply to each line of a stream: (session, at, line, reply, fen, ended), fen as it is then.

    Lines of a session are taken in order of ``at`` within a batch of the stream, so a source must not bring an earlier
    line in a later batch. Blank and null lines have no reply, nor has anything after a command to leave; lines without a
    session are left out. A line that starts with / is a command; any other is asked of ``answer`` with the turns since
    the game began. ``answer`` and ``opponent`` load their models, once a task. ``idle`` milliseconds without a line drop
    a session, which then begins anew, also after it was left; 0 keeps it. With ``idle`` a run over what is available
    now ends only if ``spark.sql.streaming.noDataMicroBatches.enabled`` is off, as timers ask for batches without data.
    Only the turns that a batch adds are written.
    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    rows = lines.select(lines[session].cast("string").alias("session"), lines[at].cast("long").alias("at"), lines[line].cast("string").alias("line")).where("session IS NOT NULL")
    return rows.groupBy("session").transformWithStateInPandas(_Session(answer, opponent, idle), REPLIES, "Append", "ProcessingTime" if idle else "None")
