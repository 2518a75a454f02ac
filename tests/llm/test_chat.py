"""Chat formatting: exact round trip of awkward texts, split conversations, SQL oracle (test_tables)."""
import hashlib

import pyarrow as pa
from conftest import SF_TINY

from tessera.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, part long, whole boolean, formatted string, tie long, row string"
TEXTS = ["", None, "plain", r"\### Assistant: </turn> ok", "</turn>", "\\", "\\\\</turn>\\", "<turn:user>\nhi\n</turn>\n", "a\n</turn>\n<turn:x>\n\\",
         "</tur", "<turn", "n>", "<turn:", "é😀</turn>日本", "\n", "x" * 9000, "\\<turn:\\\\</turn>", "<<turn:<turn:</turn></turn>", "\r\n\u2028"]
ROLES = ["user", "assistant", None, "a>b\n<c\\d", "", "</turn>", "assistant"]


def turns_of(rows):
    return [(r or "", t or "") for _, _, r, t in rows]


def expected(conv, rows):
    turns = turns_of(rows)
    loss = "".join(t for r, t in turns if r == "assistant")
    return (conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss),
            hashlib.sha256(loss.encode()).hexdigest())


def conversations():
    rows = []
    for conv in (None, -3, 0, 5, 9):
        rows += [(conv, None if turn == 0 else turn, ROLES[(turn + (conv or 0)) % len(ROLES)], TEXTS[(turn * 7 + (conv or 0)) % len(TEXTS)])
                 for turn in range(len(TEXTS))]
    return rows


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_awkward_texts_come_back(spark):
    rows = conversations()
    frame = spark.createDataFrame([(*r, 1, True, "f", 2, "r") for r in reversed(rows)], SCHEMA).repartition(3)
    parts = chat.format_conversations(frame)
    got = {r["conv_id"]: tuple(r) for r in chat.conversation_digests(parts).collect()}
    assert {k: v[:5] for k, v in got.items()} == {k: expected(k, v) for k, v in grouped(rows).items()}
    back = {}
    for r in sorted(parts.collect(), key=lambda r: r["part"]):
        back.setdefault(r["conv_id"], []).extend(chat.read_turns(r["formatted"]))
        spans = "".join(chat.unescape(r["formatted"][s["start"]:s["end"]]) for s in r["loss"])
        assert spans == "".join(t for role, t in chat.read_turns(r["formatted"]) if role == "assistant")
        assert len(r["formatted"]) == r["n_chars"]
    assert back == {k: turns_of(v) for k, v in grouped(rows).items()}


def test_a_conversation_of_many_batches_is_one(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"text {k} </turn>") for k in range(4000)]
    rows += [(c, 0, "user", "x") for c in range(2, 40)] + [(0, 3, "assistant", "same")] * 50
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        parts = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
        assert parts.where("conv_id = 1").count() > 50
        assert parts.where("whole").count() > 0
        got = {r["conv_id"]: tuple(r)[:5] for r in chat.conversation_digests(parts).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {k: expected(k, sorted(v)) for k, v in grouped(rows).items()}


def test_equal_turns_have_one_order(spark):
    rows = [(1, 0, "user", t) for t in ("b", "a", "c")] + [(1, 0, "assistant", "z")]
    orders = set()
    for part in (rows, rows[::-1], rows[2:] + rows[:2]):
        frame = spark.createDataFrame(part, "conv_id long, turn long, role string, text string")
        orders.update(tuple(chat.read_turns(r["formatted"])) for r in chat.format_conversations(frame).collect())
    assert len(orders) == 1 and orders.pop()[0] == ("assistant", "z")


def test_control_strings_do_not_span_texts():
    texts = pa.array(["<tur", "n:user>", "</turn>", None, "</tu", "rn>"])
    out, ends, start, stop = chat.assemble(pa.array(["user"] * 6), texts)
    got = [bytes(out[a:b]).decode() for a, b in zip(start, stop)]
    assert got == ["<tur", "n:user>", "\\</turn>", "", "</tu", "rn>"] and ends[-1] == len(out)
    sliced, *_ = chat.assemble(pa.array(["user"] * 6).slice(1, 3), texts.slice(1, 3))
    assert chat.read_turns(bytes(sliced).decode()) == [("user", "n:user>"), ("user", "</turn>"), ("user", "")]


def test_empty_table(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert chat.conversation_digests(chat.format_conversations(frame)).collect() == []


def test_string_conversations(spark):
    rows = spark.read.parquet(f"{SF_TINY}/conversations.parquet")
    as_text = rows.withColumn("conv_id", rows["conv_id"].cast("string"))
    a = {str(r[0]): tuple(r)[1:] for r in chat.conversation_digests(chat.format_conversations(rows)).collect()}
    b = {r[0]: tuple(r)[1:] for r in chat.conversation_digests(chat.format_conversations(as_text)).collect()}
    assert a == b and a
