import json
import random

import pytest

from corvane.chess.position import START
from corvane.streaming import sessions as S

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MATE = "rnb1kbnr/pppp1ppp/8/4p3/6Pq/5P2/PPPPP2P/RNBQKBNR w KQkq - 1 3"


def models():
    """Made inside a function, so that they travel by value."""

    def answer():
        return lambda fen, question, history: f"{question}|{len(history)}|{history[-1][1] if history else ''}|{fen.split()[1]}"

    def opponent():
        return lambda fen: "e7e5" if " b " in fen else "a2a3"

    return answer, opponent


answer, opponent = models()


def plain(lines):
    """Session by session, line by line."""
    out = {}
    for name in {s for s, *_ in lines if s is not None}:
        fen, history = START, []
        for at, line in sorted((a, x) for s, a, x in lines if s == name and x is not None):
            if not line.strip():
                continue
            reply, fen, more, ended = S.replied(line.strip(), fen, history, answer(), opponent())
            history = [] if more is None else history + more
            out[name, at] = (line.strip(), reply, fen, ended)
            if ended:
                break
    return out


@pytest.fixture
def stream(spark, tmp_path):
    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    (tmp_path / "in").mkdir()

    def run(name, lines, **options):
        with open(tmp_path / "in" / f"{name}.json", "w") as f:
            f.writelines(json.dumps({"session": s, "at": a, "line": x}) + "\n" for s, a, x in lines)
        source = spark.readStream.schema("session string, at long, line string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        replies = S.sessions(source, answer, opponent, **options)
        replies.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.schema(S.REPLIES).parquet(str(tmp_path / "out")).collect()
        assert len({(r.session, r["at"]) for r in rows}) == len(rows)
        return {(r.session, r["at"]): (r.line, r.reply, r.fen, r.ended) for r in rows}

    yield run
    for k, v in before.items():
        spark.conf.set(k, v)


def test_commands():
    say = lambda line, fen=START, history=(), bot=None: S.replied(line, fen, list(history), answer(), bot)
    reply, fen, more, ended = say("/di e4")
    assert "Bạn đi e2e4" in reply and fen.startswith("rnbqkbnr/pppppppp/8/8/4P3") and (more, ended) == ([], False)
    assert say("/di Qh8")[:2] == ("Lỗi: 'Qh8' không phải nước đi hợp lệ ở thế này", START)
    assert say("/bot")[0].startswith("Lỗi:") and say("/bot", fen, bot=opponent())[0].startswith("Máy đi e7e5.")
    assert say("/thoat")[3] and say("/quit")[3] and "/moi" in say("/giup")[0]
    assert "Không biết lệnh '/xyz'" in say("/xyz a")[0]
    assert say("/moi nothing")[:3] == ("Lỗi: 'nothing' không phải FEN hợp lệ", START, [])
    assert say(f"/moi {MATE}")[:3] == ("Ván mới.\nChiếu hết. Đen thắng.", MATE, None)
    assert say("/fen")[0] == "r n b q k b n r\np p p p p p p p\n" + ". . . . . . . .\n" * 4 + f"P P P P P P P P\nR N B Q K B N R\nFEN: {START}\nLượt Trắng."
    assert say("Ai hơn?", history=[("user", "a"), ("assistant", "b")])[0] == "Ai hơn?|2|b|w"


def test_interleaved_sessions_and_a_restart_equal_a_plain_loop(stream):
    rng = random.Random(3)
    words = ["/di e4", "/di e5", "/di Nf3", "/bot", "/fen", "/moi", f"/moi {MATE}", "Ai hơn?", "Why?", "  ", "", None, "/xyz", "/di"]
    batches, at = [], 0
    for _ in range(3):
        batch = []
        for _ in range(60):
            at += 1
            batch.append((rng.choice(["a", "b", "c", "long", None]), at, rng.choice(words)))
        batches.append(batch)
    batches[1].append(("b", 61, "/thoat"))  # what b says later has no reply
    batches[1] = [x for x in batches[1] if x[:2] != ("b", 61) or x[2] == "/thoat"]
    for batch in batches:
        rng.shuffle(batch)
    stream("0", batches[0])  # each run starts from the checkpoint of the last
    stream("1", batches[1])
    got = stream("2", batches[2])
    assert got == plain([x for b in batches for x in b])
    assert not any(s == "b" and a > 61 for s, a in got)


def test_an_idle_session_begins_anew(stream):
    import time

    stream("0", [("a", 1, "/di e4"), ("a", 2, "Why?")], idle=1)
    time.sleep(1)
    stream("1", [("other", 3, "/fen")], idle=1)  # a batch in which a's timer is seen
    got = stream("2", [("a", 4, "Again?")], idle=1)
    assert got["a", 2][1] == "Why?|0||b" and got["a", 4][1] == "Again?|0||w"
