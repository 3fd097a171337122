"""Conversations as training texts, assembled byte-wise from columns.

One turn is ``<s>[INST] role [/INST]`` + newline + text + ``</s>`` + newline.  The four
control strings ``<s>``, ``</s>``, ``[INST]`` and ``[/INST]`` cannot come from a role or text:
each gets a backslash after its bracket, and one that has backslashes there gets one more.
That is undone without loss.  The loss mask covers the assistant's texts alone.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .columns import blocks, trim, utf8

HEAD, MIDDLE, TAIL = b"<s>[INST] ", b" [/INST]\n", b"</s>\n"
LEARNED_ROLE = "assistant"
CONTROL = r"(<|\[)(\\*)(/?)(s>|INST\])"
ESCAPED = re.compile(r"(<|\[)\\(\\*)(/?)(s>|INST\])")
TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\]\n(.*?)</s>\n", re.S)
BLOCK_BYTES = 4 << 20


def escape(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(column, CONTROL, r"\1\\\2\3\4")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3\4", text)


def _scatter(out: np.ndarray, to: np.ndarray, source: np.ndarray, offsets: np.ndarray) -> None:
    """Copy the ragged texts of ``source`` to their places in ``out``."""
    index = np.repeat(to - offsets[:-1], np.diff(offsets))
    index += np.arange(len(index))
    out[index] = source[offsets[0] : offsets[-1]] if offsets[0] else source


def assemble(roles: pa.Array, texts: pa.Array, first: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted conversations; conversation i has the turns first[i] .. first[i + 1] - 1.

    Also gives each turn's text span in it, in code points.
    """
    role, role_at = utf8(escape(pc.fill_null(roles, "")))
    text, text_at = utf8(escape(pc.fill_null(texts, "")))
    n_role, n_text = np.diff(role_at), np.diff(text_at)
    size = len(HEAD) + n_role + len(MIDDLE) + n_text + len(TAIL)
    ends = np.cumsum(size)
    begin = ends - size
    buffer = pa.allocate_buffer(int(ends[-1]) if len(ends) else 0)
    out = np.frombuffer(buffer, np.uint8)
    role_to = begin + len(HEAD)
    middle_to = role_to + n_role
    text_to = middle_to + len(MIDDLE)
    for to, fixed in ((begin, HEAD), (middle_to, MIDDLE), (ends - len(TAIL), TAIL)):
        out[to[:, None] + np.arange(len(fixed))] = np.frombuffer(fixed, np.uint8)
    _scatter(out, role_to, role, role_at)
    _scatter(out, text_to, text, text_at)
    edges = np.concatenate([[0], ends])[first]
    points = np.zeros(len(out) + 1, np.int64)
    np.cumsum((out & 0xC0) != 0x80, out=points[1:])
    own = np.repeat(points[edges[:-1]], np.diff(first))
    offsets = pa.py_buffer(edges.astype(np.int64).tobytes())
    whole = pa.Array.from_buffers(pa.large_string(), len(first) - 1, [None, offsets, buffer]).cast(pa.string())
    return whole, points[text_to] - own, points[text_to + n_text] - own


def format_chat(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, loss) per conversation of ``turns`` (conv_id, turn, role, text).

    ``loss`` lists the (start, end) code points of the assistant's texts in ``formatted``.
    Turns stand in the order of ``turn``; ties and repeated rows are kept, ordered by role and
    text, nulls first.  A null role or text is empty.  Rows without a conv_id are one
    conversation.  An empty table has none.  Other columns are not looked at.

    A conversation is one text, so its turns meet in one task; that is the only grouping.
    """
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    slim = grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    schema = StructType([slim.schema["conv_id"], *StructType.fromDDL("n_turns bigint, formatted string, loss array<struct<start: int, end: int>>")])

    def run(batches):
        for batch in batches:
            for part in _formatted(batch):
                yield pa.RecordBatch.from_arrays(part, names=schema.names)
            batch = part = None
        trim()

    return slim.mapInArrow(run, schema)


def _formatted(batch: pa.RecordBatch):
    ids, lists = batch.column(0), batch.column(1)
    first = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)))]).astype(np.int64)
    flat = lists.flatten()
    roles, texts = flat.field("role"), flat.field("text")
    lengths = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64) + 64)])
    for lo, hi in blocks(lengths[first], BLOCK_BYTES):
        a, b = first[lo], first[hi]
        role = pc.fill_null(roles.slice(a, b - a), "")
        own = first[lo : hi + 1] - a
        whole, start, end = assemble(role, texts.slice(a, b - a), own)
        learned = np.asarray(pc.equal(role, LEARNED_ROLE))
        marks = np.concatenate([[0], np.cumsum(learned)])[own]
        spans = pa.StructArray.from_arrays(
            [pa.array(start[learned], pa.int32()), pa.array(end[learned], pa.int32())], names=["start", "end"]
        )
        loss = pa.ListArray.from_arrays(pa.array(marks, pa.int32()), spans)
        yield [ids.slice(lo, hi - lo), pa.array(np.diff(own), pa.int64()), whole, loss]


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs that a formatted conversation was made from."""
    return [(unescape(r), unescape(t)) for r, t in TURN.findall(formatted)]


def read_back(chats: DataFrame) -> DataFrame:
    """Digests of what :func:`format_chat`'s output holds, got from that output alone."""
    schema = StructType([
        chats.schema["conv_id"],
        *StructType.fromDDL("n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"),
    ])

    def run(batches):
        for batch in batches:
            rows = []
            for text, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = read_turns(text)
                digest = hashlib.sha256()
                for role, said in turns:
                    digest.update(f"{role}\n{said}\n".encode())
                learned = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                rows.append((len(turns), digest.hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=schema.names
            )

    return chats.select("conv_id", "formatted", "loss").mapInArrow(run, schema)
