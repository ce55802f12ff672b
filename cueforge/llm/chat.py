"""Chat formatting: conversations as marked-up text with a loss mask, assembled by column."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueforge.llm.common import in_order, slices

#: A conversation of more text is formatted in parts of about this many bytes, cut between turns.
PART_BYTES = 1 << 20
#: Segments over this many bytes are copied as runs, shorter ones by an index for each byte.
RUN_BYTES = 4096

#: Marks of the template: a turn that is learned, and any other.
LEARNED = ("<s>", "</s>\n")
OTHER = ("[INST] ", "[/INST]\n")
#: A control string in a text gets one more backslash after its first character, so that none stands bare and each comes back.
_CONTROL = r"([<\[])(\\*/?(?:s>|INST\]))"
_ESCAPED = re.compile(r"([<\[])\\(\\*/?(?:s>|INST\]))")

PARTS = "part long, n_turns int, formatted string, loss_begin array<int>, loss_end array<int>"


def unescape(text: str) -> str:
    """A text as it was before its control strings were escaped."""
    return _ESCAPED.sub(r"\1\2", text)


def _role_out(role: str) -> str:
    return re.sub(_CONTROL, r"\1\\\2", role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    at = 0
    while at < len(formatted):
        learned = formatted.startswith(LEARNED[0], at)
        begin = at + len(LEARNED[0]) if learned else formatted.index("\n", at) + 1
        role = "assistant" if learned else _role_in(formatted[at + len(OTHER[0]) : begin - 1])
        end = (LEARNED if learned else OTHER)[1]
        stop = formatted.index(end, begin)
        yield role, unescape(formatted[begin:stop])
        at = stop + len(end)


def _put(out: np.ndarray, at: np.ndarray, source: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """Copy each segment of ``source`` to its place in ``out``."""
    long = length > RUN_BYTES
    for a, s, n in zip(at[long].tolist(), start[long].tolist(), length[long].tolist(), strict=True):
        out[a : a + n] = source[s : s + n]
    a, s, n = at[~long], start[~long], length[~long]
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(a, n) + inside] = source[np.repeat(s, n) + inside]


def _new(ids: pa.Array) -> np.ndarray:
    """Whether each row begins another conversation than the row before it."""
    a, b = ids[1:], ids[:-1]
    other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
    return np.concatenate(([True], np.asarray(other)))


def _assembled(rows: pa.RecordBatch, first_part: int) -> pa.RecordBatch:
    """The formatted conversations of consecutive rows: lengths, offsets, then one copy into a buffer of the right size."""
    coded = pc.fill_null(pc.cast(rows.column("role"), pa.large_string()), "").dictionary_encode()
    roles, of = coded.dictionary.to_pylist(), np.asarray(coded.indices)
    heads = [LEARNED[0] if r == "assistant" else f"{OTHER[0]}{_role_out(r)}\n" for r in roles]
    tails = [(LEARNED if r == "assistant" else OTHER)[1] for r in roles]
    marks = [x.encode() for x in heads + tails]
    mark_len = np.array([len(x) for x in marks], np.int64)
    mark_at = np.cumsum(mark_len) - mark_len
    body = pc.replace_substring_regex(pc.fill_null(pc.cast(rows.column("text"), pa.large_string()), ""), _CONTROL, r"\1\\\2")
    off = np.frombuffer(body.buffers()[1], np.int64)[body.offset : body.offset + len(body) + 1]
    text = np.frombuffer(body.buffers()[2] or b"", np.uint8)

    length = np.stack([mark_len[of], np.diff(off), mark_len[of + len(roles)]], 1)
    at = (np.cumsum(length) - length.ravel()).reshape(length.shape)
    buffer = pa.allocate_buffer(int(length.sum()))
    out = np.frombuffer(buffer, np.uint8)
    pool = np.frombuffer(b"".join(marks), np.uint8)
    _put(out, at[:, 0], pool, mark_at[of], length[:, 0])
    _put(out, at[:, 1], text, off[:-1], length[:, 1])
    _put(out, at[:, 2], pool, mark_at[of + len(roles)], length[:, 2])

    # Parts begin where the conversation changes; places in them count code points.
    begin = np.flatnonzero(_new(rows.column("conv_id")))
    head_n, tail_n = (np.array([len(x) for x in xs], np.int64)[of] for xs in (heads, tails))
    text_n = pc.utf8_length(body).to_numpy().astype(np.int64)
    chars = np.cumsum(head_n + text_n + tail_n) - (head_n + text_n + tail_n)
    part = np.searchsorted(begin, np.arange(len(of)), "right") - 1
    learned = np.flatnonzero(np.array([r == "assistant" for r in roles], bool)[of])
    loss = (chars - chars[begin][part] + head_n)[learned]
    cuts = pa.array(np.searchsorted(part[learned], np.arange(len(begin) + 1)).astype(np.int32))
    spans = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (loss, loss + text_n[learned])]
    places = np.append(at[begin, 0], length.sum()).astype(np.int32)
    formatted = pa.Array.from_buffers(pa.string(), len(begin), [None, pa.py_buffer(places), buffer])
    n = np.diff(np.append(begin, len(of))).astype(np.int32)
    return pa.RecordBatch.from_arrays([rows.column("conv_id").take(pa.array(begin)), pa.array(first_part + np.arange(len(begin))), pa.array(n), formatted, *spans], ["conv_id", "part", "n_turns", "formatted", "loss_begin", "loss_end"])


def _whole(batches: Iterator[pa.RecordBatch], part_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches that end where a conversation does, or after ``part_bytes`` of one."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        for piece in slices(batch, limit=part_bytes):
            rows = piece if held is None else pa.concat_batches([held, piece])
            last = int(np.flatnonzero(_new(rows.column("conv_id")))[-1])
            if last:
                yield rows.slice(0, last)
            held = rows.slice(last)
            if (pc.sum(pc.binary_length(held.column("text"))).as_py() or 0) >= part_bytes:
                yield held
                held = None
    if held is not None:
        yield held


def format_chats(rows: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows (conv_id, part, n_turns, formatted, loss_begin, loss_end) of ``rows(conv_id, turn, role, text)``.

    Turns are in order of turn (nulls first; ties by a hash of role and text, so that it never depends on partitions).
    An assistant's turn is ``<s>text</s>``, any other ``[INST] role⏎text[/INST]``, each on a line of its own; control strings
    and the line ends of roles are escaped and come back by ``turns``. The loss spans are code points of ``formatted``: the
    assistant's texts, and nothing else. The rows are dealt by ranges of (conversation, turn), so a huge conversation is
    spread over tasks; it has several rows then, in order of ``part``, as has one of over ``part_bytes`` or at the edge of a range.

    A null role or text is empty; a null conv_id is a conversation of its own; repeated rows are turns; an empty table gives no
    row; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 33
        for whole in _whole(batches, part_bytes):
            out = _assembled(whole, part)
            part += out.num_rows
            yield out

    x = rows.select("conv_id", "turn", "role", "text").withColumn("_tie", F.xxhash64(F.struct("role", "text")))
    kind = rows.schema["conv_id"].dataType.simpleString()
    return in_order(x, "conv_id", "turn", "_tie").select("conv_id", "role", "text").mapInArrow(run, f"conv_id {kind}, {PARTS}")


def read_back(parts: DataFrame) -> DataFrame:
    """Rows (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) read from formatted conversations alone.

    A conversation's parts meet in one task and pass through it one after another; only the running digests are held.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        key, state = None, None

        def closed() -> tuple:
            n, told, loss_n, loss, chars = state
            return (key[0], n, told.hexdigest(), loss_n, loss.hexdigest(), chars)

        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            kinds = [batch.column("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            for piece in slices(batch, "formatted"):
                for conv, formatted, begin, end in zip(*(piece.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_begin", "loss_end")), strict=True):
                    if key != (conv,):
                        if key is not None:
                            done.append(closed())
                        key, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    for role, text in turns(formatted):
                        state[0] += 1
                        state[1].update(f"{role}\n{text}\n".encode())
                    for a, b in zip(begin, end, strict=True):
                        text = unescape(formatted[a:b])
                        state[2] += len(text)
                        state[3].update(text.encode())
                    state[4] += len(formatted)
                if done:
                    yield batch_of(done)
                    done = []
        if key is not None:
            yield batch_of([closed()])

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = parts.schema["conv_id"].dataType.simpleString()
    x = parts.select("conv_id", "part", "formatted", "loss_begin", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return x.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
