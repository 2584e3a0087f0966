"""Chat formatting by columnar byte assembly.

Turns are sorted by conversation and turn, and each Arrow batch is formatted as a whole: lengths of headers, contents and
footers, their cumulative offsets, and scatter indices are computed in numpy, and all bytes are copied into one
preallocated buffer that becomes an Arrow column. A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings in
texts are escaped reversibly: in ``<``, any number of backslashes, ``|`` one more backslash is put in, so that ``<|`` never
occurs inside a text. The loss mask is a span of bytes for each turn: the assistant's text, or nothing.

A conversation may be of any length: rows are streamed in order, one batch at a time, and what is carried from batch to
batch is a running digest.

Defined results: null texts and roles are empty ones; line ends and backslashes in a role are escaped; rows with a null
conversation form one conversation of null id; within one, null turns come first, and equal turns are ordered by role and
text; repeated rows stay; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = b"<|im_start|>", b"<|im_end|>\n"
TURN = re.compile(rb"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
ESCAPED = re.compile(rb"<(\\*)\\\|")
MOST_BYTES = 32 << 20  # of contents that are assembled at once


def escape(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(column, pattern=r"<(\\*)\|", replacement=r"<\1\\|")


def unescape(data: bytes) -> bytes:
    return ESCAPED.sub(rb"<\1|", data)


def escape_role(column: pa.Array) -> pa.Array:
    return escape(pc.replace_substring(pc.replace_substring(column, "\\", "\\\\"), "\n", "\\n"))


def unescape_role(data: bytes) -> bytes:
    return re.sub(rb"\\(.)", lambda m: b"\n" if m[1] == b"n" else m[1], unescape(data))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def _copy(out: np.ndarray, to: np.ndarray, source: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
    """out[to[i] : to[i] + size[i]] = source[begin[i] : begin[i] + size[i]] for all i at once."""
    total = int(size.sum())
    if total:
        before = np.cumsum(size) - size
        run = np.arange(total)
        out[run + np.repeat(to - before, size)] = source[run + np.repeat(begin - before, size)]


def assemble(roles: pa.Array, contents: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted turns as one Arrow column over one buffer, and begin and end of each turn's text in its turn."""
    n = len(roles)
    role, role_at = _flat(escape_role(roles))
    text, text_at = _flat(escape(contents))
    role_size, text_size = np.diff(role_at), np.diff(text_at)
    fixed = np.frombuffer(START + b"\n" + END, np.uint8)
    sizes = np.stack([np.full(n, len(START)), role_size, np.ones(n, np.int64), text_size, np.full(n, len(END))], 1)
    ends = np.cumsum(sizes.ravel()).reshape(n, 5)
    begins = ends - sizes
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    _copy(out, begins[:, 0], fixed, np.zeros(n, np.int64), sizes[:, 0])
    _copy(out, begins[:, 1], role, role_at[:-1], sizes[:, 1])
    _copy(out, begins[:, 2], fixed, np.full(n, len(START)), sizes[:, 2])
    _copy(out, begins[:, 3], text, text_at[:-1], sizes[:, 3])
    _copy(out, begins[:, 4], fixed, np.full(n, len(START) + 1), sizes[:, 4])
    offsets = np.concatenate([[0], ends[:, -1]]).astype(np.int64) if n else np.zeros(1, np.int64)
    column = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(out)])
    return column, begins[:, 3] - begins[:, 0], ends[:, 3] - begins[:, 0]


def ordered(df: DataFrame, keys: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text")) -> DataFrame:
    """Each conversation's rows in one partition, in order."""
    c, t, r, x = keys
    plain = df.select(F.col(c).alias("conv_id"), F.col(t).alias("turn"), F.coalesce(F.col(r), F.lit("")).alias("role"), F.coalesce(F.col(x), F.lit("")).alias("text"))
    return plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts take MOST_BYTES at most, or one row."""
    size = pc.fill_null(pc.binary_length(batch.column(3)), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(size) // MOST_BYTES) if len(size) else size
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def format_turns(df: DataFrame, assistant: str = "assistant") -> DataFrame:
    """conv_id, turn, formatted (bytes), loss_begin, loss_end: joined in order, a conversation's rows are its formatted form."""
    ids = df.schema["conv_id"].dataType, df.schema["turn"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _blocks(batch):
                column, begin, end = assemble(part.column(2), part.column(3))
                lost = pc.equal(part.column(2), assistant).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), column.cast(pa.binary()), pa.array(begin), pa.array(np.where(lost, end, begin))], ["conv_id", "turn", "formatted", "loss_begin", "loss_end"])

    out = T.StructType([T.StructField("conv_id", ids[0]), T.StructField("turn", ids[1]), T.StructField("formatted", T.BinaryType()), T.StructField("loss_begin", T.LongType()), T.StructField("loss_end", T.LongType())])
    return ordered(df).mapInArrow(run, out)


def conversation_digests(turns: DataFrame) -> DataFrame:
    """One row a conversation, read back from the formatted bytes and masks of ``format_turns``, in whose order rows still are."""
    kind = turns.schema["conv_id"].dataType
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = run  # no conversation yet
        n = loss = chars = 0
        every, lost = hashlib.sha256(), hashlib.sha256()

        def row() -> tuple:
            return now, n, every.hexdigest(), loss, lost.hexdigest(), chars

        for batch in batches:
            rows = []
            for conv, data, a, b in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if conv != now or now is run:
                    if now is not run:
                        rows.append(row())
                    now, n, loss, chars = conv, 0, 0, 0
                    every, lost = hashlib.sha256(), hashlib.sha256()
                formatted = data.as_py()
                found = TURN.fullmatch(formatted)
                if not found:
                    raise ValueError("a formatted turn can't be read")
                n += 1
                every.update(unescape_role(found[1]) + b"\n" + unescape(found[2]) + b"\n")
                masked = unescape(formatted[a:b])
                loss += len(masked.decode())
                lost.update(masked)
                chars += len(formatted.decode())
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), *(pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True))], names)
        if now is not run:
            last = [[x] for x in row()]
            yield pa.RecordBatch.from_arrays([pa.array(last[0], batch.schema.field(0).type), *(pa.array(c, k) for c, k in zip(last[1:], kinds, strict=True))], names)

    out = T.StructType([T.StructField("conv_id", kind), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])
    return turns.select("conv_id", "formatted", "loss_begin", "loss_end").mapInArrow(run, out)
