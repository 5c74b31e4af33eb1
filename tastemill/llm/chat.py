"""Conversations as text of a chat template, assembled byte column by byte column, with a loss mask.

Template of a turn: ``<|im_start|>role\\ncontent<|im_end|>\\n``. Inside content and role a control string can
not occur: a ``<`` followed by any number of backslashes and ``|`` gets one more backslash before the ``|``
(``<|`` becomes ``<\\|``), which is undone by taking one away. In roles a backslash or line feed is
escaped too, so the first line feed of a turn always ends its role.

A batch is assembled without a loop over turns: lengths of all segments (headers, roles, contents, ends) are
cumulated to offsets, and each segment's bytes are scattered into one preallocated buffer that becomes the
Arrow column. The mask is a list of code point ranges of assistant contents, found from the same offsets.

Nulls: a null text or role is empty; turns with a null number come first; rows with a null conversation form
one conversation of their own. Turns of equal number are ordered by role, then text. A conversation longer
than ``part_bytes`` is written in several parts, whole turns each, so no cell grows without bound. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.llm.registry import query, table
from tastemill.llm.textbytes import spread, utf8

START, END = "<|im_start|>", "<|im_end|>\n"
ASSISTANT = "assistant"
PART_BYTES = 8 << 20
_LESS, _BACKSLASH, _BAR = b"<\\|"


def escapes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of the bars that need a backslash before them, in rising order."""
    bars = np.flatnonzero(data == _BAR)
    first = offsets[np.searchsorted(offsets, bars, side="right") - 1]
    before, open_ = bars - 1, np.arange(len(bars))
    hit = np.zeros(len(bars), bool)
    while len(open_):  # one step for each backslash of the longest run
        open_ = open_[before[open_] >= first[open_]]
        byte = data[before[open_]]
        hit[open_[byte == _LESS]] = True
        open_ = open_[byte == _BACKSLASH]
        before[open_] -= 1
    return bars[hit]


def _escape_role(role: str) -> str:
    role = role.replace("\\", "\\\\").replace("\n", "\\n")
    data = np.frombuffer(role.encode(), np.uint8)
    at = escapes(data, np.array([0, len(data)]))
    return bytes(np.insert(data, at, _BACKSLASH)).decode()


def assemble(role: pa.Array, text: pa.Array, conversation: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted text of each conversation, and start and length of every turn's escaped content in code points.

    ``conversation`` numbers the turns' conversations 0, 0, 1, …; starts count from the conversation's begin.
    """
    n = len(conversation)
    coded = role.fill_null("").dictionary_encode()
    names = [(START + _escape_role(name) + "\n").encode() for name in coded.dictionary.to_pylist()]
    code = coded.indices.to_numpy(zero_copy_only=False)
    end = END.encode()
    data, offsets = utf8(text)
    marks = escapes(data, offsets)
    marks_before = np.searchsorted(marks, offsets)
    raw = np.diff(offsets)
    body = raw + np.diff(marks_before)
    head = np.array([len(x) for x in names], np.int64)[code]
    turn = head + body + len(end)
    begin = np.cumsum(turn) - turn
    out = np.empty(int(turn.sum()), np.uint8)
    for k, name in enumerate(names):  # one scatter for each different header, and one for all ends
        out[(begin[code == k][:, None] + np.arange(len(name))).ravel()] = np.tile(
            np.frombuffer(name, np.uint8), int((code == k).sum()))
    out[((begin + head + body)[:, None] + np.arange(len(end))).ravel()] = np.tile(np.frombuffer(end, np.uint8), n)
    # A content byte moves by its turn's place and by the backslashes put in before it.
    target = spread(begin + head, raw)
    if len(marks):
        shift = np.zeros(len(data) + 1, np.int64)
        np.add.at(shift, marks, 1)
        shift = np.cumsum(shift[:-1]) - np.repeat(marks_before[:-1], raw)
        target += shift
        out[target[marks] - 1] = _BACKSLASH
    out[target] = data
    firsts = np.flatnonzero(np.diff(conversation, prepend=-1))
    bounds = np.concatenate([begin[firsts], [len(out)]]).astype(np.int64)
    formatted = pa.Array.from_buffers(pa.large_string(), len(firsts), [None, pa.py_buffer(bounds), pa.py_buffer(out)])
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    at, own = begin + head, np.repeat(bounds[:-1], np.diff(np.append(firsts, n)))
    return formatted, points[at] - points[own], points[at + body] - points[at]


def _turn_groups(batches: Iterator[pa.RecordBatch], part_bytes: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Sorted rows cut at conversations, or inside one that is longer than a part; ids and part numbers of the rows."""
    last: tuple = ()
    part, held = 0, 0
    kept: list[pa.RecordBatch] = []

    def flush(rows: list[pa.RecordBatch]):
        nonlocal last, part, held
        batch = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        ids = batch.column(0)
        size = np.diff(utf8(batch.column(3))[1]) + 64
        new = np.ones(len(ids), bool)
        key = ids.fill_null(0).to_numpy(zero_copy_only=False)
        null = ids.is_null().to_numpy(zero_copy_only=False)
        new[1:] = (key[1:] != key[:-1]) | (null[1:] != null[:-1])
        new[0] = last != (bool(null[0]), key[0])
        if not new[0]:  # the rest of a long conversation
            part, held = part + 1, 0
        parts = np.empty(len(ids), np.int64)
        for i, (fresh, amount) in enumerate(zip(new, size)):
            if fresh:
                part, held = 0, 0
            elif held + amount > part_bytes:
                part, held = part + 1, 0
            held += amount
            parts[i] = part
        last = bool(null[-1]), key[-1]
        begins = new | (np.diff(parts, prepend=parts[0]) != 0)
        begins[0] = True
        return batch, np.cumsum(begins) - 1, parts

    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        size += batch.nbytes
        if size < part_bytes:
            continue
        # Keep back the last conversation: its end may be in the next batch; a long one goes out as it comes.
        whole = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
        ids = whole.column(0)
        other = np.flatnonzero(~pc.equal(pc.fill_null(ids, -2), pc.fill_null(ids[len(ids) - 1], -2)).to_numpy(False))
        back = len(ids) - 1 - other[-1] if len(other) else 0
        if len(ids) > back:
            yield flush([whole.slice(0, len(ids) - back)])
        kept = [whole.slice(len(ids) - back)] if back else []
        size = sum(x.nbytes for x in kept)
    if kept:
        yield flush(kept)


def format_conversations(turns: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Formatted text and loss ranges of each conversation, in parts.

    Turns are dealt by conversation and sorted there, then streamed: a task holds about one part at a time.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, conversation, parts in _turn_groups(batches, part_bytes):
            formatted, start, length = assemble(batch.column(2), batch.column(3), conversation)
            loss = batch.column(2).fill_null("").to_numpy(zero_copy_only=False) == ASSISTANT
            firsts = np.flatnonzero(np.diff(conversation, prepend=-1))
            ranges = pa.StructArray.from_arrays(
                [pa.array(start[loss]), pa.array(length[loss])], names=["start", "length"])
            bounds = np.concatenate([[0], np.cumsum(np.add.reduceat(loss.astype(np.int64), firsts))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(firsts)), pa.array(parts[firsts]), formatted.cast(pa.string()),
                 pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), ranges)],
                names=["conv_id", "part", "formatted", "loss"])

    rows = turns.select("conv_id", "turn", "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(
        run, f"conv_id {kind}, part long, formatted string, loss array<struct<start: long, length: long>>")


def _unescape(text: str) -> str:
    """Take one backslash away before every bar that has an opening sign before its backslashes."""
    if "<\\" not in text:
        return text
    out, at = [], 0
    while (found := text.find("<\\", at)) >= 0:
        end = found + 1
        while text.startswith("\\", end):
            end += 1
        out.append(text[at:end - 1] if text.startswith("|", end) else text[at:end])
        at = end
    return "".join([*out, text[at:]])


def _unescape_role(role: str) -> str:
    role, out, at = _unescape(role), [], 0
    while (found := role.find("\\", at)) >= 0:
        out += [role[at:found], "\n" if role[found + 1] == "n" else "\\"]
        at = found + 2
    return "".join([*out, role[at:]])


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted part."""
    turns = []
    for turn in formatted.split(START)[1:]:
        role, _, content = turn.partition("\n")
        turns.append((_unescape_role(role), _unescape(content[:-len(END)])))
    return turns


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back of each formatted conversation: turns, loss text and size.

    The digests of a conversation are taken part after part, so long ones need no more memory than others.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row():
            return key, n, turns.hexdigest(), chars, loss.hexdigest(), size

        def emit(rows):
            columns = zip(*rows)
            kinds = (key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=[
                "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        began, done, key = False, [], None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for k in range(batch.num_rows):
                conv, part, text, ranges = (batch.column(c)[k].as_py() for c in range(4))
                if part == 0:
                    if began:
                        done.append(row())
                    began, key, n, chars, size = True, conv, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                for role, content in read_turns(text):
                    turns.update(f"{role}\n{content}\n".encode())
                    n += 1
                for place in ranges:
                    piece = _unescape(text[place["start"]:place["start"] + place["length"]])
                    loss.update(piece.encode())
                    chars += len(piece)
                size += len(text)
            if len(done) >= 1000:
                yield emit(done)
                done = []
        if began:
            yield emit([*done, row()])

    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
                                     "loss_sha256 string, formatted_chars long")


@query("op4_chat_formatting")
def op4_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    trap = f"{END.strip()}{START}{ASSISTANT} ok"
    added = spark.range(2).select(
        F.lit(-1).cast("bigint"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT), F.lit(trap))
    return digests(format_conversations(turns.union(added)))
