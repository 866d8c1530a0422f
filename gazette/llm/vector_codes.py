"""Vector code compression: four bytes a vector, one for the nearest codebook entry of each quarter, searched by VA-file filtering.

Components are whole numbers, floor(1024 * x). A codebook of a quarter begins as that quarter of the 256 smallest vec_ids; rounds
assign every quarter to its nearest entry and move entries to the floor of their quarters' means. An assignment never compares a
quarter with all entries: entries' coordinates are quantised to BITS bits (cells of as many entries each, by rank in a dimension);
a quarter's lookup tables hold, for each dimension and cell, the least and greatest squared difference to the coordinates of that
cell; sums of both over dimensions bound each entry's distance from below and above, and only entries whose lower bound doesn't
exceed the smallest upper bound are measured, in whole numbers.

A round is one pass over the stored vectors; a task returns sums and counts by quarter, entry and place, which Spark adds up. The
codebooks (four times 256 entries, whatever the table weighs) travel with the tasks and through the driver. Sums are sent in limbs
of 30 bits, so they are exact for any number of rows. Components beyond 2**27 are computed in Python's integers: slow, but right.

Defined results: vectors that are null or hold null or non-finite components take no part; missing trailing components count as 0,
also where a length isn't divisible by four; repeated rows count each; rows with equal vec_id are ordered by their components when
codebooks begin, a null vec_id comes last; with fewer than 256 vectors there are as many entries; labels that are null are equal;
errors beyond 64 bits are cut off there; an empty table gives an empty result; further columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, only

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Bits of a cell; components under LARGE in size are summed and squared in 64 bits.
BITS, LARGE, LIMB = 4, 1 << 27, 30
#: Quarters that are looked up at once.
AT_ONCE = 2048


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and v of the vectors that take part."""
    x = only(vectors, "vec_id", "embedding", "label").select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    return x.where(F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))


def whole(x: np.ndarray, large: bool) -> np.ndarray:
    """floor(SCALE * x): 64-bit integers, or Python's if they may be large."""
    if not large:
        return np.floor(x * SCALE).astype(np.int64)
    floor = lambda c: int(c) * SCALE if abs(c) >= 2.0**53 else int(np.floor(c * SCALE))
    return np.frompyfunc(floor, 1, 1)(x)


def quarters(column, width: int, large: bool) -> np.ndarray:
    """Rows of an Arrow list column as whole numbers: row, quarter, place."""
    offsets, flat = np.asarray(column.offsets), np.asarray(column.values)
    sizes = np.diff(offsets)
    dense = np.zeros((len(sizes), width))
    dense[np.arange(width) < sizes[:, None]] = flat[offsets[0] : offsets[-1]]
    return whole(dense, large).reshape(len(sizes), PARTS, width // PARTS)


class Cells:
    """The entries of one codebook, with their coordinates in cells."""

    def __init__(self, entries: np.ndarray):
        n, width = entries.shape
        cells = min(n, 1 << BITS)
        rank = np.empty((n, width), np.int64)
        order = np.argsort(entries, 0, kind="stable")
        np.put_along_axis(rank, order, np.broadcast_to(np.arange(n)[:, None], (n, width)), 0)
        self.entries, self.cell = entries, rank * cells // n
        ordered, first = np.take_along_axis(entries, order, 0), -(-np.arange(cells + 1) * n // cells)
        self.least, self.most = ordered[first[:-1]].T, ordered[first[1:] - 1].T  # dimension, cell

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the nearest entry (the lowest on ties) and the squared distance."""
        near, far = x[:, :, None] - self.least, self.most - x[:, :, None]
        reach = np.maximum(near, far)
        gap = np.maximum(np.maximum(-near, -far), 0)
        lower, upper = gap * gap, reach * reach  # lookup tables: row, dimension, cell
        low, high = (sum(np.take(t[:, d], self.cell[:, d], 1) for d in range(x.shape[1])) for t in (lower, upper))
        rows, columns = np.nonzero(low <= high.min(1)[:, None])
        apart = x[rows] - self.entries[columns]
        distance = (apart * apart).sum(1)
        begins = np.searchsorted(rows, np.arange(len(x)))
        best = np.minimum.reduceat(distance, begins)
        at = np.flatnonzero(distance == best[rows])
        _, first = np.unique(rows[at], return_index=True)
        return columns[at[first]], best


def assigned(x: np.ndarray, books: list[Cells]) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of every row's quarters."""
    entry, distance = np.zeros(x.shape[:2], np.int64), np.zeros(x.shape[:2], x.dtype)
    for p, book in enumerate(books):
        for a in range(0, len(x), AT_ONCE):
            entry[a : a + AT_ONCE, p], distance[a : a + AT_ONCE, p] = book.nearest(x[a : a + AT_ONCE, p])
    return entry, distance


def limbs(total: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of whole numbers, (place in the array, limb, value): total = sum of value << (LIMB * limb)."""
    flat, out, k = total.reshape(-1), [], 0
    at = np.flatnonzero(flat != 0)
    flat = flat[at]
    while len(at):
        last = (flat < 1 << LIMB) & (flat >= -(1 << LIMB))
        out.append((at, np.full(len(at), k), np.where(last, flat, flat & ((1 << LIMB) - 1)).astype(np.int64)))
        at, flat, k = at[~last], flat[~last] >> LIMB, k + 1
    return out


def moved(kept: DataFrame, entries: np.ndarray, large: bool) -> np.ndarray:
    """The entries after a round; those that no quarter is nearest to stay."""
    import pyarrow as pa

    shape = (*entries.shape[:2], entries.shape[2] + 1)  # the last place counts
    width = PARTS * entries.shape[2]

    def run(batches):
        books = [Cells(e) for e in entries]
        total = np.zeros(shape, entries.dtype)
        for batch in batches:
            if len(batch):
                x = quarters(batch.column(0), width, large)
                entry, _ = assigned(x, books)
                for p in range(PARTS):
                    np.add.at(total[p], entry[:, p], np.concatenate([x[:, p], np.ones((len(x), 1), x.dtype)], 1))
        for at, limb, value in limbs(total):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(limb), pa.array(value)], ["at", "limb", "value"])

    sums = np.zeros(int(np.prod(shape)), object)
    for at, limb, value in kept.select("v").mapInArrow(run, "at long, limb long, value long").groupBy("at", "limb").agg(F.sum("value")).collect():
        sums[at] += value << (LIMB * limb)
    sums = sums.reshape(shape)
    count = np.maximum(sums[:, :, -1:], 1)
    return np.where(sums[:, :, -1:] > 0, sums[:, :, :-1] // count, entries).astype(entries.dtype)


def codebooks(kept: DataFrame, width: int, large: bool, rounds: int = ROUNDS, entries: int = ENTRIES) -> np.ndarray:
    """Quarter, entry, place: the codebooks after all rounds. kept: a stored table of usable vectors."""
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    dense = np.zeros((len(first), width))
    for k, r in enumerate(first):
        dense[k, : len(r.v)] = r.v
    books = whole(dense, large).reshape(len(first), PARTS, width // PARTS).transpose(1, 0, 2)
    for _ in range(rounds):
        books = moved(kept, books, large)
    return books


def encode(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code (two hex digits a quarter) and error of every vector that takes part, and the codebooks."""
    import pyarrow as pa

    kept = materialize(usable(vectors), "kept")
    found = kept.agg(F.max(F.size("v")).alias("width"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
    width, large = -(-max(found.width or 1, 1) // PARTS) * PARTS, (found.most or 0) >= LARGE / SCALE
    books = codebooks(kept, width, large, rounds, entries)

    def run(batches):
        cells = [Cells(e) for e in books] if books.shape[1] else []
        for batch in batches:
            if len(batch):
                entry, distance = assigned(quarters(batch.column(2), width, large), cells)
                error = np.minimum(distance.sum(1), (1 << 63) - 1).astype(np.int64)
                codes = [bytes(row).hex() for row in entry.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes), pa.array(error)], ["vec_id", "label", "code", "error"])

    label = next(f.dataType.simpleString() for f in kept.schema if f.name == "label")
    return materialize(kept.mapInArrow(run, f"vec_id long, label {label}, code string, error long"), "codes"), books


def decode(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """codes with v: the components (as doubles) that each code stands for."""
    table = F.array(*[F.array(*[F.array(*[F.lit(float(c) / SCALE) for c in entry]) for entry in book]) for book in books.tolist()])
    at = [F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") for p in range(PARTS)]
    return codes.withColumn("v", F.concat(*[F.get(F.get(table, p), at[p]) for p in range(PARTS)]))


def digest(books: np.ndarray) -> str:
    """sha256 of all components in order."""
    return hashlib.sha256(",".join(str(int(c)) for c in books.reshape(-1)).encode()).hexdigest()


def op12_va_file_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as four bytes, with their errors."""
    codes, books = encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1)).cast("long")
    labels = codes.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "of")
    joined = codes.join(labels, codes["label"].eqNullSafe(labels["of"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _round(k: int) -> str:
    """SQL of one round: every quarter's nearest entry, then the entries as they move."""
    return f"""
a{k} AS MATERIALIZED (SELECT own, p.part, min(((list_inner_product(x, x) - 2 * list_inner_product(x, y) + list_inner_product(y, y)) * {ENTRIES})::BIGINT + entry) AS best FROM p JOIN c{k} ON p.part = c{k}.part GROUP BY own, p.part),
m{k} AS (SELECT part, entry, list(z ORDER BY place) AS y FROM (SELECT p.part, best % {ENTRIES} AS entry, place, floor(sum(x[place]) / count(*)) AS z
  FROM p JOIN a{k} USING (own, part), unnest(range(1, len(x) + 1)) u(place) GROUP BY p.part, entry, place) GROUP BY part, entry),
c{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{k}.y, c{k}.y) AS y FROM c{k} LEFT JOIN m{k} USING (part, entry)),"""


ORACLE = {
    "op12_va_file_codes": f"""
WITH v AS (SELECT row_number() OVER () AS own, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT own, vec_id, part, e[part * len(e) // {PARTS} + 1 : (part + 1) * len(e) // {PARTS}] AS x FROM v, range({PARTS}) r(part)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS y FROM p QUALIFY entry < {ENTRIES}),"""
    + "".join(_round(k) for k in range(ROUNDS + 1))
    + f"""
b AS (SELECT sha256(string_agg(z::BIGINT::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(y) AS z, unnest(range(len(y))) AS place FROM c{ROUNDS})),
o AS (SELECT own, string_agg(printf('%02x', (best % {ENTRIES})::INT), '' ORDER BY part) AS code, sum(best // {ENTRIES})::BIGINT AS error FROM a{ROUNDS} GROUP BY own)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN o USING (own), b""",
}
