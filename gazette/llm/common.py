"""Helpers that several corpus operators share: byte-level tokens, texts of Arrow columns, runs of sorted rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.sources.tables import free, mark, materialize, scratch, setting, shared_dir  # noqa: F401  operators take them from here

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of an Arrow batch, for rows that are blocks of many, and its bytes (64 MB where nothing else is set).
BATCH, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Java and RE2 agree on these.
WHITE = r"[\x20\x09-\x0D]+"
NOT_WHITE = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def only(docs: DataFrame, *names: str) -> DataFrame:
    """The columns an operator needs, so that further columns with any names can't clash with its own."""
    return docs.select(*[F.col(f"`{n}`") for n in names])


def packed(docs: DataFrame, **own: Column) -> DataFrame:
    """The caller's rows as one column `row` beside columns of an operator's own, so that no names can clash; unpacked() undoes it."""
    return docs.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row"), *[c.alias(name) for name, c in own.items()])


def unpacked(rows: DataFrame, text: Column | None = None) -> DataFrame:
    """The caller's columns as they were, or with another text."""
    names = rows.schema["row"].dataType.names
    return rows.select(*[(text if text is not None and c.lower() == "text" else F.col("row").getField(c)).alias(c) for c in names])


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) <= n:
        size, made = 1 << max(12, int(n).bit_length()), []
        for base in (_BASE, _INVERSE):
            out = np.ones(1, np.uint64)
            step = base
            while len(out) < size:
                out = np.concatenate([out, out * np.uint64(step)])
                step = step * step % (1 << 64)
            made.append(out)
        _powers = made[0], made[1]
    return _powers


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string array; a null is an empty text."""
    import pyarrow as pa

    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 20):
    """Row ranges of at most so many bytes (one row at least)."""
    begin, n = 0, len(offsets) - 1
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1)
        yield begin, min(end, n)
        begin = min(end, n)


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that follow one another in raw: for each word (bytes apart from 0x20 and 0x09-0x0D, A-Z lowered)
    its 64-bit hash, begin and end, and for each text the number of its first word (one more entry at the end)."""
    n = len(raw)
    low = raw + ((raw >= 65) & (raw <= 90)).view(np.uint8) * np.uint8(32)
    word = np.zeros(n + 2, bool)  # with a place before and one after
    np.logical_and(low != 32, (low < 9) | (low > 13), out=word[1:-1])
    edge = np.zeros(n + 1, bool)  # a text begins or ends here
    edge[offsets] = True
    begins = np.flatnonzero(word[1:] & (~word[:-1] | edge))
    ends = np.flatnonzero(word[:-1] & (~word[1:] | edge))
    power, inverse = _grown(n)
    prefix = np.zeros(n + 1, np.uint64)
    np.multiply(low + np.uint16(1), power[:n], out=prefix[1:])
    np.cumsum(prefix[1:], out=prefix[1:])
    hashed = mix64((prefix[ends] - prefix[begins]) * inverse[begins] + (ends - begins).astype(np.uint64))
    return hashed, begins, ends, np.searchsorted(begins, offsets)


def by_key(batches, names: tuple[str, ...]):
    """Of Arrow batches sorted by the column `key`: (key, table) for each run, across batches."""
    import pyarrow as pa

    held, last = [], None
    for batch in batches:
        if not len(batch):
            continue
        key = batch.column(batch.schema.get_field_index("key")).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and key[a] != last:
                yield last, pa.Table.from_batches(held).select(names)
                held = []
            held.append(batch.slice(a, b - a))
            last = key[a]
    if held:
        yield last, pa.Table.from_batches(held).select(names)
