r"""Chat formatting by columnar byte assembly, and reading the format back.

A turn is written as `<turn ROLE>\n`, its text, `</turn>\n`. Inside texts and roles a backslash is
doubled and one more is put before `<turn` and `</turn` (in roles also before `>` and line ends), so
that control strings in a text never end a turn and the text comes back exactly.

Rows are dealt by conversation and sorted by turn (ties: role, then text); each task assembles the
turns of a batch at once: segment lengths, their running sums and scatter indices in numpy, then one
copy of all headers and one of all contents into a buffer that Arrow takes over. A conversation is
one row, unless it exceeds `part_bytes`: it then goes on in further rows (`part` 0, 1, ...), so that
no task holds an unbounded one.

Null text and null role count as empty. Repeated turns are repeated. Rows without a conv_id form
one conversation of their own. Empty tables give no rows. Extra input columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

OPEN, MIDDLE, CLOSE = "<turn ", ">\n", "</turn>\n"
LOSS_ROLE = "assistant"
TURN = re.compile(r"<turn ((?:[^\\>]|\\.)*+)>\n((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
_OUT = "conv_id {}, part int, formatted string, n_turns long, loss_starts array<long>, loss_ends array<long>"


def escape(col: pa.Array, role: bool = False) -> pa.Array:
    for plain in ("\\", "<turn", "</turn", *((">", "\n") if role else ())):
        col = pc.replace_substring(col, plain, ("\\\\" if plain == "\\" else "\\" + plain))
    return col


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in TURN.finditer(formatted)]


def _scatter(out: np.ndarray, at: np.ndarray, sizes: np.ndarray, data: np.ndarray, start: np.ndarray | None = None) -> None:
    """Copies runs of bytes of the given sizes to the places `at`; from `start`, or one after another."""
    run = np.cumsum(sizes) - sizes
    step = np.arange(int(sizes.sum()))
    source = step if start is None else np.repeat(start - run, sizes) + step
    out[np.repeat(at - run, sizes) + step] = data[source]


def _bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and the size of each string."""
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], np.diff(offsets)


def assemble(batch: pa.RecordBatch, part: int) -> pa.RecordBatch:
    """Formats the conversations of a sorted batch; the first of them goes on from part `part` - 1."""
    conv, n = batch.column("conv_id"), batch.num_rows
    role, text = (pc.fill_null(batch.column(c), "") for c in ("role", "text"))
    names = role.dictionary_encode()
    code = names.indices.to_numpy(zero_copy_only=False)
    heads = pc.binary_join_element_wise(OPEN, escape(names.dictionary, True), MIDDLE, "")
    contents = escape(text)
    head_data, head_sizes = _bytes(heads)
    body_data, body_sizes = _bytes(contents)
    tail = np.frombuffer(CLOSE.encode(), np.uint8)
    head_at = np.cumsum(head_sizes) - head_sizes
    sizes = head_sizes[code] + body_sizes + len(tail)
    at = np.cumsum(sizes) - sizes
    buffer = pa.allocate_buffer(int(sizes.sum()))
    out = np.frombuffer(buffer, np.uint8)
    _scatter(out, at, head_sizes[code], head_data, head_at[code])
    _scatter(out, at + head_sizes[code], body_sizes, body_data)
    _scatter(out, at + sizes - len(tail), np.full(n, len(tail)), np.tile(tail, n))
    # conversations are runs of equal conv_id; code points count for the loss mask
    known = conv.is_valid().to_numpy(zero_copy_only=False)
    key = pc.fill_null(conv, 0).to_numpy(zero_copy_only=False) if not pa.types.is_string(conv.type) else np.array(conv.to_pylist(), object)
    new = np.r_[True, (key[1:] != key[:-1]) | (known[1:] != known[:-1])]
    first = np.flatnonzero(new)
    head_chars, body_chars = pc.utf8_length(heads).to_numpy()[code].astype(np.int64), pc.utf8_length(contents).to_numpy().astype(np.int64)
    chars = head_chars + body_chars + len(CLOSE)
    inside = np.cumsum(chars) - chars
    inside -= np.repeat(inside[first], np.diff(np.r_[first, n]))
    loss = code == (names.dictionary.to_pylist().index(LOSS_ROLE) if LOSS_ROLE in names.dictionary.to_pylist() else -1)
    cuts = np.r_[0, np.cumsum(np.add.reduceat(loss.astype(np.int32), first))].astype(np.int32)
    starts = (inside + head_chars)[loss]
    offsets = np.r_[at[first], sizes.sum()].astype(np.int32)
    made = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.tobytes()), buffer)
    parts = np.zeros(len(first), np.int32)
    parts[0] = part
    return pa.RecordBatch.from_arrays(
        [conv.take(pa.array(first)), pa.array(parts), made, pa.array(np.diff(np.r_[first, n]).astype(np.int64)), pa.ListArray.from_arrays(cuts, pa.array(starts)), pa.ListArray.from_arrays(cuts, pa.array(starts + body_chars[loss]))],
        names=["conv_id", "part", "formatted", "n_turns", "loss_starts", "loss_ends"],
    )


def format_conversations(df: DataFrame, part_bytes: int = 16 << 20) -> DataFrame:
    """conv_id, part, formatted, n_turns, and the loss mask as spans of code points of `formatted`.

    The parts of a conversation follow each other in one partition."""

    kind = df.schema["conv_id"].dataType.simpleString()

    def body(batches):
        held, sent, parts = None, object(), 0

        def send(rows):
            nonlocal sent, parts
            keys = rows.column("conv_id")
            part = parts if keys[0].as_py() == sent else 0
            made = assemble(rows, part)
            sent, parts = keys[-1].as_py(), (part + 1 if made.num_rows == 1 else 1)
            return made

        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                rows = batch.slice(lo, 1000)
                if held is not None:
                    rows = pa.Table.from_batches([held, rows]).combine_chunks().to_batches()[0]
                keys = rows.column("conv_id").to_pylist()
                k = len(keys) - 1
                while k and keys[k - 1] == keys[-1]:
                    k -= 1
                if k:
                    yield send(rows.slice(0, k))
                held = rows.slice(k)
                if held.nbytes > part_bytes:
                    yield send(held)
                    held = None
        if held is not None:
            yield send(held)

    src = df.select("conv_id", F.col("turn"), "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return src.mapInArrow(body, _OUT.format(kind))


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Reads formatted conversations back: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def body(batches):
        key, state = object(), None

        def row():
            n, turns, chars, loss, size = state
            return {"conv_id": key, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": size}

        for batch in batches:
            done = []
            for conv, part, text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "formatted", "loss_starts", "loss_ends"))):
                if part == 0:
                    if state:
                        done.append(row())
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for a, b in zip(starts, ends):
                    plain = unescape(text[a:b])
                    state[2] += len(plain)
                    state[3].update(plain.encode())
                state[4] += len(text)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if state:
            yield pa.RecordBatch.from_pylist([row()], schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    names = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    spark_schema = StructType([formatted.schema["conv_id"], *StructType.fromDDL(names)])
    schema = to_arrow_schema(spark_schema)
    return formatted.mapInArrow(body, spark_schema)
