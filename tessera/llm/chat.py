"""Chat formatting: the turns of a conversation as one marked-up text with a loss mask.

Template, one block per turn, in order of turn::

    <turn:ROLE>
    TEXT
    </turn>

A control string (``<turn:`` or ``</turn>``) inside a text gets one backslash in front.
Those of the template stand at the start of a line and so never follow a
backslash; inside texts they always do, and reading drops one.  Roles are written
with ``\\`` ``>`` ``<`` and line ends as backslash escapes.  The loss mask holds the spans
(code points, end exclusive) of the texts of the trained roles, as escaped.

Rows are sorted by range over (conversation, turn), so a conversation that holds a
large part of all rows is spread over many tasks; each Arrow batch of sorted rows
is formatted by columns: segment lengths, cumulative offsets and scatter indices in
numpy, headers and contents copied into one preallocated buffer.  A conversation
that lies within one batch is one row (``whole``); another one is a row per batch,
``part`` in order, to be joined without anything between.

Defined cases: a null text or role is empty; a null conversation is one
conversation; equal turns of a conversation are ordered by role and a hash of the
text, repeated rows stay; empty table: no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import bound_batches, write_shared

OPEN, CLOSE = "<turn:", "</turn>"
HEAD_END, FOOT = ">\n", f"\n{CLOSE}\n"
TRAINED = ("assistant",)
BACKSLASH = ord("\\")

SPANS = "array<struct<start: bigint, end: bigint>>"
READ = "struct<n_turns: bigint, transcript: string, trained: string>"

_ROLE_ESCAPES = {"\\": "\\\\", ">": "\\g", "<": "\\l", "\n": "\\n"}
_ROLE_TEXT = {v[1]: k for k, v in _ROLE_ESCAPES.items()}
_TURN = re.compile(rf"(?<!\\){OPEN}([^>]*){HEAD_END}(.*?)\n(?<!\\){CLOSE}\n", re.S)
_ESCAPED = re.compile(rf"\\(?={OPEN}|{CLOSE})")


def header(role: str) -> bytes:
    return f"{OPEN}{''.join(_ROLE_ESCAPES.get(c, c) for c in role)}{HEAD_END}".encode()


def unescape(text: str) -> str:
    return _ESCAPED.sub("", text)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    return [(re.sub(r"\\(.)", lambda m: _ROLE_TEXT[m[1]], role), unescape(text)) for role, text in _TURN.findall(formatted)]


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and bytes of a string array, null as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return ends - ends[0], whole[ends[0]:ends[-1]]


def control_places(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Places of control strings that lie within one text."""
    less = np.flatnonzero(data == ord("<"))
    limit = offsets[np.searchsorted(offsets, less, "right")]
    found = np.zeros(len(less), bool)
    for control in (OPEN.encode(), CLOSE.encode()):
        fits = np.flatnonzero(less + len(control) <= limit)
        for k in range(1, len(control)):
            fits = fits[data[less[fits] + k] == control[k]]
        found[fits] = True
    return less[found]


def _within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the lengths in turn."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The formatted bytes of all turns, the ends of the turns in it, and start and
    end of their texts."""
    coded = roles.fill_null("").dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    heads = [header(r) for r in coded.dictionary.to_pylist()]
    head_len = np.fromiter(map(len, heads), np.int64, len(heads))
    head_at = np.cumsum(head_len) - head_len
    head_bytes = np.frombuffer(b"".join(heads), np.uint8)
    offsets, data = _flat(texts)
    length = np.diff(offsets)
    escape = control_places(offsets, data)
    escapes_before = np.searchsorted(escape, offsets)
    foot = np.frombuffer(FOOT.encode(), np.uint8)

    own = head_len[code]
    body = length + np.diff(escapes_before)
    ends = np.cumsum(own + body + len(foot))
    start = ends - len(foot) - body
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    step = _within(own)
    out[np.repeat(start - own, own) + step] = head_bytes[np.repeat(head_at[code], own) + step]
    to = np.arange(len(data)) + np.repeat(start - offsets[:-1], length)
    if len(escape):
        passed = np.zeros(len(data), np.int64)
        passed[escape] = 1
        to += np.cumsum(passed) - np.repeat(escapes_before[:-1], length)
        out[to[escape] - 1] = BACKSLASH
    out[to] = data
    out[(ends - len(foot))[:, None] + np.arange(len(foot))] = foot
    return out, ends, start, start + body


def _format_batch(batch: pa.RecordBatch, number: int, trained: tuple[str, ...]) -> pa.RecordBatch:
    ids, roles, texts = batch.columns
    out, ends, text_from, text_to = assemble(roles, texts)
    keys = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    last = np.concatenate([first[1:], [len(keys)]]) - 1
    at = np.concatenate([[0], ends[last]])
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])  # code points before each byte
    part_of = np.repeat(np.arange(len(first)), last - first + 1)
    base = points[at[:-1]][part_of]
    mask = np.isin(roles.fill_null("").to_numpy(zero_copy_only=False).astype(object), trained)
    spans = pa.StructArray.from_arrays([pa.array((points[x] - base)[mask]) for x in (text_from, text_to)], ["start", "end"])
    span_at = np.concatenate([[0], np.cumsum(mask)])[np.concatenate([first, [len(keys)]])]
    whole = np.ones(len(first), bool)
    whole[[0, -1]] = False  # the batches before and after may hold more of these
    if at[-1] > np.iinfo(np.int32).max:
        raise ValueError("a batch of turns is longer than 2 GiB")
    formatted = pa.StringArray.from_buffers(len(first), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(out))
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(first)), pa.array(np.full(len(first), number)), pa.array(whole), pa.array(np.diff(points[at])),
         formatted, pa.ListArray.from_arrays(pa.array(span_at, pa.int32()), spans)],
        ["conv_id", "part", "whole", "n_chars", "formatted", "loss"])


def format_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                         trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """Formatted conversations: conv_id, part, whole, n_chars, formatted, loss (spans)."""
    spark = rows.sparkSession
    bound_batches(spark)
    # the last key spreads repeated rows of one turn over tasks, too
    keyed = rows.select(rows[conv_id].alias("conv_id"), rows[turn].alias("turn"), rows[role].alias("role"), rows[text].alias("text"),
                        F.xxhash64(rows[text]).alias("tie"), F.monotonically_increasing_id().alias("row"))
    order = ["conv_id", "turn", "role", "tie", "row"]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(b for b in batches if b.num_rows):
            yield _format_batch(batch, before + k, trained)

    key = T.StructField("conv_id", rows.schema[conv_id].dataType)
    rest = T._parse_datatype_string(f"part long, whole boolean, n_chars long, formatted string, loss {SPANS}")
    return dealt.mapInArrow(run, T.StructType([key, *rest]))


def read_back(formatted: Column, loss: Column) -> Column:
    """Struct column (n_turns, transcript, trained) read from formatted parts: the
    transcript is role, line end, text, line end of each turn; ``trained`` the
    unescaped text under the loss mask."""
    @F.arrow_udf(READ)
    def read(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, masks in batches:
            n_turns, transcripts, under = [], [], []
            for text, spans in zip(texts.to_pylist(), masks.to_pylist()):
                turns = read_turns(text)
                n_turns.append(len(turns))
                transcripts.append("".join(f"{r}\n{t}\n" for r, t in turns))
                under.append("".join(unescape(text[s["start"]:s["end"]]) for s in spans))
            yield pa.StructArray.from_arrays([pa.array(n_turns, pa.int64()), pa.array(transcripts, pa.string()), pa.array(under, pa.string())],
                                             ["n_turns", "transcript", "trained"])

    return read(formatted, loss)


def conversation_digests(parts: DataFrame) -> DataFrame:
    """Per conversation, read back from its formatted parts: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The parts of a split conversation are hashed one after another, sorted by part,
    in one stream that holds no more than a batch: a SHA-256 has an order."""
    read = parts.select("conv_id", "part", "whole", F.col("n_chars").alias("formatted_chars"), read_back(F.col("formatted"), F.col("loss")).alias("r"))
    digest = {"turns_sha256": "r.transcript", "loss_sha256": "r.trained"}
    stored = write_shared(read.select(
        "conv_id", "part", "whole", "r.n_turns", F.length("r.trained").cast("long").alias("loss_chars"), "formatted_chars",
        *[F.when(F.col("whole"), F.sha2(c, 256)).alias(name) for name, c in digest.items()],
        *[F.when(~F.col("whole"), F.col(c)).alias(c[2:]) for c in digest.values()]), "conversations")
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    split = (stored.where("not whole").select("conv_id", "part", "n_turns", "loss_chars", "formatted_chars", "transcript", "trained")
             .repartition("conv_id").sortWithinPartitions("conv_id", "part"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield from batch.to_pylist()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, group in groupby(rows(batches), key=lambda r: r["conv_id"]):
            sums = dict.fromkeys(("n_turns", "loss_chars", "formatted_chars"), 0)
            turns, loss = hashlib.sha256(), hashlib.sha256()
            for r in group:
                turns.update(r["transcript"].encode())
                loss.update(r["trained"].encode())
                for name in sums:
                    sums[name] += r[name]
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, **sums, "turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest()}], schema=out)

    schema = stored.select(*columns).schema
    out = pa.schema([("conv_id", _arrow_type(schema["conv_id"].dataType)), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                     ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    return stored.where("whole").select(*columns).unionByName(split.mapInArrow(joined, schema))


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


def oracle(more: str) -> str:
    """DuckDB SQL of ``conversation_digests`` over the table conversations and the
    rows ``more`` (conv_id, turn, role, text)."""
    shown = f"replace(replace(text, '{OPEN}', '\\{OPEN}'), '{CLOSE}', '\\{CLOSE}')"
    fixed = len(OPEN) + len(HEAD_END) + len(FOOT)
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL {more}))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({fixed} + length(role) + length({shown})) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""
