"""Chat formatting: conversations assembled as bytes in preallocated buffers.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts every ``<|`` gets a
backslash after ``<`` (and ``<\\|`` one more, and so on), so no text can hold a control string and
the escape can be taken back exactly. New lines in roles are escaped as well.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
CHUNK_BYTES = 8_000_000  # scattered at once
TRAINED = "assistant"

_OPEN = re.compile(r"<\\*(?=\|)")
_CLOSED = re.compile(r"<\\(\\*\|)")


def escape(text: str) -> str:
    return _OPEN.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _CLOSED.sub(r"<\1", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _buffer(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings in a row, and the length of each."""
    import pyarrow as pa

    array = pa.array(strings, pa.large_string())
    ends = np.frombuffer(array.buffers()[1], dtype=np.int64, count=len(strings) + 1)
    data = array.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8), np.diff(ends)


def _scatter(out: np.ndarray, at: np.ndarray, source: np.ndarray, lengths: np.ndarray) -> None:
    """Copy each segment of ``source`` to its place in ``out``, a bounded number of bytes at a time."""
    ends = np.cumsum(lengths)
    shift = at - (ends - lengths)
    first = 0
    while first < len(lengths):
        begin = ends[first] - lengths[first]
        last = max(first + 1, int(np.searchsorted(ends, begin + CHUNK_BYTES, side="right")))
        part = slice(begin, ends[last - 1])
        places = np.repeat(shift[first:last], lengths[first:last]) + np.arange(part.start, part.stop)
        out[places] = source[part]
        first = last


def assemble(roles: list[str], texts: list[str], conversation: np.ndarray):
    """Formatted conversations of a run of turns.

    ``conversation`` numbers each turn's conversation from 0 without gaps. Returns the Arrow string
    array, and for every turn the code points where its text starts and ends in its conversation.
    """
    import pyarrow as pa

    heads, head_len = _buffer([f"{START}{_escape_role(r)}\n" for r in roles])
    bodies, body_len = _buffer([escape(t) for t in texts])
    tail = np.frombuffer(END.encode(), dtype=np.uint8)
    turn_len = head_len + body_len + len(tail)
    ends = np.cumsum(turn_len)
    begins = ends - turn_len
    total = int(ends[-1]) if len(ends) else 0
    out = pa.allocate_buffer(total)
    view = np.frombuffer(out, dtype=np.uint8)
    _scatter(view, begins, heads, head_len)
    _scatter(view, begins + head_len, bodies, body_len)
    _scatter(view, ends - len(tail), np.tile(tail, len(roles)), np.full(len(roles), len(tail)))
    firsts = np.searchsorted(conversation, np.arange(conversation[-1] + 1)) if len(conversation) else np.zeros(0, int)
    offsets = np.append(begins[firsts], total).astype(np.int64)
    # Code points before each byte: bytes that continue a character do not count.
    points = np.concatenate([[0], np.cumsum((view & 0xC0) != 0x80)])
    zero = points[begins[firsts]][conversation] if len(conversation) else np.zeros(0, int)
    starts = points[begins + head_len] - zero
    stops = points[begins + head_len + body_len] - zero
    strings = pa.LargeStringArray.from_buffers(len(firsts), pa.py_buffer(offsets), out)
    return strings, starts, stops


def format_conversations(turns: DataFrame, trained: str = TRAINED) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss (spans of code points under the loss mask).

    Turns (conv_id, turn, role, text; more columns are not read) are put in order of turn, role and
    text, nulls first; null roles and texts are empty. Null conv_ids form one conversation. Rows that
    repeat a turn all stay. A conversation is one row, so it is gathered in one task; tasks stream
    over many conversations and hold one Arrow batch and the conversation at its end.
    """
    import pyarrow as pa

    kind = turns.schema["conv_id"].dataType.simpleString()
    ordered = (
        turns.select("conv_id", "turn", "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .drop("turn")
    )

    def whole(batches: Iterable[pa.RecordBatch]):
        """Batches that end where a conversation ends."""
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            ids = batch.column("conv_id").to_pylist()
            cut = next((i for i in range(len(ids) - 1, 0, -1) if ids[i] != ids[i - 1]), 0)
            if held and (cut or held[-1].column("conv_id")[-1].as_py() != ids[0]):
                if held[-1].column("conv_id")[-1].as_py() != ids[0]:
                    yield pa.concat_tables(held)
                    held = []
            if cut:
                yield pa.concat_tables([*held, table.slice(0, cut)])
                held = []
            held.append(table.slice(cut))
        if held:
            yield pa.concat_tables(held)

    def formatted(batches: Iterable[pa.RecordBatch]):
        for table in whole(batches):
            ids, roles, texts = (table.column(c).to_pylist() for c in ("conv_id", "role", "text"))
            new = np.array([True] + [a != b for a, b in zip(ids[1:], ids)])
            conversation = np.cumsum(new) - 1
            roles, texts = [r or "" for r in roles], [t or "" for t in texts]
            strings, starts, stops = assemble(roles, texts, conversation)
            loss: list[list[dict]] = [[] for _ in range(len(strings))]
            for k, role, a, b in zip(conversation.tolist(), roles, starts.tolist(), stops.tolist()):
                if role == trained:
                    loss[k].append({"start": a, "end": b})
            heads = table.column("conv_id").combine_chunks().filter(pa.array(new))
            spans = pa.array(loss, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([heads, strings.cast(pa.string()), spans], ["conv_id", "formatted", "loss"])

    schema = f"conv_id {kind}, formatted string, loss array<struct<start:bigint,end:bigint>>"
    return ordered.mapInArrow(formatted, schema)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn, read back from a formatted conversation."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, _, text = part[: -len(END)].partition("\n")
        turns.append((_unescape_role(role), unescape(text)))
    return turns


def digests(conversations: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from them."""
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def batches(frames: Iterable):
        import pandas as pd

        def hexed(parts) -> str:
            return hashlib.sha256("".join(parts).encode()).hexdigest()

        for frame in frames:
            rows = []
            for conv_id, text, loss in zip(frame["conv_id"], frame["formatted"], frame["loss"]):
                turns = parse(text)
                learned = [unescape(text[s["start"] : s["end"]]) for s in loss]
                rows.append(
                    (conv_id, len(turns), hexed(f"{r}\n{t}\n" for r, t in turns), sum(map(len, learned)), hexed(learned), len(text))
                )
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pd.DataFrame(rows, columns=names)

    return conversations.mapInPandas(
        batches,
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
