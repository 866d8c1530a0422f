"""Exact top-k search by inner product over norm-sorted vectors.

Vectors are packed, by falling length, into blocks; queries are packed too. The longest vectors alone give each query a first
k-th score. A query block then meets, by falling length, those runs of vector blocks whose longest vector can still reach a k-th
score: a prefix, as lengths fall. In a block, the first coordinates after rotation by the singular vectors of the data give a
partial product; with the product of the residual lengths (Cauchy-Schwarz) it bounds the whole, and only vectors whose bound
reaches the k-th score so far are scored exactly. Runs are processed apart and merged by rank.

The query set is stated; all vectors are candidates. A task holds QUERY_RUN query blocks and reads a run of RUN vector blocks one
by one; so a vector is sent once for every 8192 queries that may reach it, a query once for every 65536 vectors.

Defined results: vectors that are null or hold null or non-finite components take no part; missing trailing components count
as 0; a query's own row is no candidate, other rows with its vec_id are; repeated candidates are ranked each; repeated query
rows give their results once each; a null vec_id is a candidate but no query; with fewer than k candidates all return. Scores
beyond 64 bits are cut off at the ends of the range.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BATCH, materialize, only, setting

QUERY_BLOCK, VECTOR_BLOCK, QUERY_RUN, RUN, HEAD = 1024, 4096, 8, 16, 16


def usable(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """vec_id and v: floor(scale * x) of every component, as doubles, of the vectors that take part."""
    x = only(vectors, "vec_id", "embedding").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    good = F.col("e").isNotNull() & ~F.exists("e", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    floor = lambda c: F.when(F.abs(c) < 1e14, F.floor(c * scale).cast("double")).otherwise(c * scale)  # noqa: E731  beyond 2**53 all doubles are whole
    return x.where(good).select("vec_id", F.transform("e", floor).alias("v"))


def norm(v: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, c: a + c * c))


def _dense(column, width: int) -> np.ndarray:
    """Lists of doubles as rows, filled up with zeros."""
    offsets, flat = np.asarray(column.offsets), np.asarray(column.values)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat[offsets[0] : offsets[-1]]
    return out


BLOCK = "part int, seq int, top double, n int, ids binary, known binary, row binary, rows binary"


def packed(vectors: DataFrame, width: int, size: int) -> DataFrame:
    """BLOCK rows: at most `size` vectors each, by falling norm, numbered by part and seq; top: the greatest norm."""
    import pyarrow as pa

    def block(seq, ids, known, row, rows):
        blobs = (ids, known, row, rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([seq], pa.int32()), pa.array([float(np.sqrt((rows * rows).sum(1)).max())]), pa.array([len(rows)], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in blobs]],
            ["part", "seq", "top", "n", "ids", "known", "row", "rows"],
        )

    def run(batches):
        seq, held, waiting = 0, [], 0
        for batch in batches:
            if len(batch):
                ids = batch.column(0)
                held.append((np.asarray(ids.fill_null(0)), ~np.asarray(ids.is_null()), np.asarray(batch.column(1)), _dense(batch.column(2), width)))
                waiting += len(batch)
            while waiting >= size:
                every = tuple(np.concatenate(x) for x in zip(*held, strict=True))
                yield block(seq, *(x[:size] for x in every))
                held, waiting, seq = [tuple(x[size:] for x in every)], waiting - size, seq + 1
        if waiting:
            yield block(seq, *(np.concatenate(x) for x in zip(*held, strict=True)))

    parts = max(1, -(-vectors.count() // (RUN * size)))
    ordered = vectors.withColumn("norm", norm(F.col("v"))).repartitionByRange(parts, F.desc("norm"), F.col("vec_id")).sortWithinPartitions(F.desc("norm"), "vec_id")
    return ordered.select(F.col("vec_id").cast("long"), "row", "v").mapInArrow(run, BLOCK)


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """The right singular vectors of the data, by falling singular value, from second moments that Spark sums."""
    import pyarrow as pa

    def sums(batches):
        total = np.zeros((width, width))
        for batch in batches:
            x = _dense(batch.column(0), width)
            total += x.T @ x
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "s"])

    moments = np.zeros((width, width))
    for i, j, s in vectors.select("v").mapInArrow(sums, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s")).collect():
        moments[i, j] = moments[j, i] = s
    return np.linalg.eigh(np.nan_to_num(moments))[1][:, ::-1]


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: by doubles where no sum can leave 2**53, else by Python's integers."""
    if not q.size or not v.size or np.abs(q).max() * np.abs(v).max() * q.shape[1] < 2**53:
        return (q @ v.T).astype(np.int64)
    whole = lambda x: np.array([[int(c) for c in row] for row in x], object)
    return np.clip(whole(q) @ whole(v).T, -(2**63), 2**63 - 1).astype(np.int64)


class Best:
    """The k best of each query of a block so far."""

    def __init__(self, ids: np.ndarray, row: np.ndarray, rows: np.ndarray, turn: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.row, self.rows, self.k, self.floor = ids, row, rows, k, floor.copy()
        self.turned, self.norm = rows @ turn, np.sqrt((rows * rows).sum(1))
        self.rest = np.sqrt((self.turned[:, HEAD:] ** 2).sum(1))
        self.found: list[list[tuple[int, int, bool]]] = [[] for _ in ids]

    def meet(self, ids: np.ndarray, known: np.ndarray, row: np.ndarray, rows: np.ndarray, turned: np.ndarray) -> None:
        longest = float(np.sqrt((rows * rows).sum(1)).max()) if len(rows) else 0.0
        live = np.flatnonzero(self.norm * longest * (1 + 1e-9) + 1e-6 >= self.floor)
        if not len(live):
            return
        rest, slack = np.sqrt((turned[:, HEAD:] ** 2).sum(1)), 1e-9 * self.norm[live, None] * longest + 1e-6
        able = self.turned[live, :HEAD] @ turned[:, :HEAD].T + self.rest[live, None] * rest + slack >= self.floor[live, None]
        columns = np.flatnonzero(able.any(0))
        if not len(columns):
            return
        score = _exact(self.rows[live], rows[columns])
        able = able[:, columns] & (score >= self.floor[live, None])
        for i, q in enumerate(live):
            at = np.flatnonzero(able[i] & (row[columns] != self.row[q]))
            if len(at):
                if len(at) > self.k:  # what lies under the k-th of these can go at once
                    at = at[score[i, at] >= np.partition(score[i, at], -self.k)[-self.k]]
                new = [(-int(score[i, a]), int(ids[columns[a]]), bool(known[columns[a]])) for a in at]
                self.found[q] = sorted(self.found[q] + new, key=lambda x: (x[0], not x[2], x[1]))[: self.k]
                if len(self.found[q]) == self.k:
                    self.floor[q] = max(self.floor[q], -self.found[q][-1][0])


def search(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score. vectors: vec_id, v; queries are the rows whose vec_id is divisible by `every`."""
    import pyarrow as pa

    spark = vectors.sparkSession
    vectors = materialize(vectors.withColumn("row", F.monotonically_increasing_id()), "vectors")
    width = max(1, vectors.agg(F.max(F.size("v"))).first()[0] or 1)
    blocks, asked = (materialize(packed(x, width, size), name) for x, size, name in ((vectors, VECTOR_BLOCK, "blocks"), (vectors.where(f"vec_id % {every} = 0"), QUERY_BLOCK, "queries")))
    # a number for each run of blocks: blocks are numbered by falling norm
    run = F.floor(F.col("seq") / RUN).cast("int")
    order = blocks.groupBy("part", run.alias("r")).agg(F.max("top").alias("top")).orderBy("part", "r").collect()
    tops = np.array([r.top for r in order])
    runs = spark.createDataFrame([(r.part, r.r, i) for i, r in enumerate(order)], "part int, r int, run int")
    turn = rotation(vectors, width)

    def unpacked(r) -> list[np.ndarray]:
        return [np.frombuffer(r["ids"], np.int64), np.frombuffer(r["known"], bool), np.frombuffer(r["row"], np.int64), np.frombuffer(r["rows"]).reshape(r["n"], width)]

    head = [unpacked(r) for r in blocks.orderBy("part", "seq").limit(1).collect()]

    def first(batches):
        """Query blocks with the k-th scores that the longest vectors give them, and how many runs they reach."""
        for batch in batches:
            for r in batch.to_pylist():
                ids, _, row, rows = unpacked(r)
                best = Best(ids, row, rows, turn, k, np.full(r["n"], -np.inf))
                for h in head:
                    best.meet(*h, h[-1] @ turn)
                reach = (best.norm[:, None] * tops * (1 + 1e-9) + 1e-6 >= best.floor[:, None]).any(0)
                r |= {"floor": best.floor.tobytes(), "runs": int(reach.sum())}
                yield pa.RecordBatch.from_pylist([r], pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("top", pa.float64()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("ids", "known", "row", "rows", "floor")], ("runs", pa.int32())]))

    with setting(spark, BATCH, "8"):
        asked = materialize(asked.mapInArrow(first, BLOCK + ", floor binary, runs int"), "asked").withColumn("group", F.shiftleft(F.col("part").cast("long"), 32) + F.floor(F.col("seq") / QUERY_RUN))
    reached = lambda rows: rows.withColumn("run", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)))
    columns = ["group", "run", "part", "seq", "n", "ids", "known", "row", "rows"]
    queries = reached(asked.where("runs > 0")).select(*columns, "floor")
    groups = reached(asked.groupBy("group").agg(F.max("runs").alias("runs")).where("runs > 0")).select("group", "run")
    sent = blocks.withColumn("r", run).join(F.broadcast(runs), ["part", "r"]).join(groups, "run").select(*columns, F.lit(None).cast("binary").alias("floor"))

    def meet(batches):
        """Query blocks of a group come first (they have a floor), then the vector blocks of a run."""
        now, waiting = None, []

        def out():
            rows = [(part * (1 << 40) + seq * QUERY_BLOCK + i, int(best.ids[i]), v if some else None, -s) for part, seq, best in waiting for i, found in enumerate(best.found) for s, v, some in found]
            parts = list(zip(*rows, strict=True)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in parts], ["asked", "query_id", "vec_id", "score"])

        for batch in batches:
            for r in batch.to_pylist():
                if (r["group"], r["run"]) != now:
                    if waiting:
                        yield out()
                    now, waiting = (r["group"], r["run"]), []
                ids, known, row, rows = unpacked(r)
                if r["floor"] is not None:
                    waiting.append((r["part"], r["seq"], Best(ids, row, rows, turn, k, np.frombuffer(r["floor"]))))
                else:
                    turned = rows @ turn
                    for _, _, best in waiting:
                        best.meet(ids, known, row, rows, turned)
        if waiting:
            yield out()

    both = queries.unionByName(sent).repartition("group", "run").sortWithinPartitions("group", "run", F.col("floor").isNull(), "part", "seq")
    with setting(spark, BATCH, "8"):
        met = materialize(both.mapInArrow(meet, "asked long, query_id long, vec_id long, score long"), "met")
    rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_norm_sorted_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all vectors for every twentieth one."""
    return search(usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


ORACLE = {
    "op5_norm_sorted_topk": r"""
WITH v AS (SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.own, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.own <> c.own WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
}
