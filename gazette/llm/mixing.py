"""Mixing sources to target weights by hash-threshold histograms.

Every record has a fixed 60-bit hash of its doc_id and text. A source's target is met by whole repeats of all its records
plus one more repeat of those whose hash lies under a threshold; budgets nest, as a larger one only raises the threshold.
The threshold comes from sums of words by source and hash bucket: the bucket in which the budget ends is split again, and
of what is left there, a few records of each source, the exact hashes are summed. The corpus itself is never sorted.

Defined results: a null or empty text has size 0 and is taken 0 times its words; a null source is a source of its own, the
last; records with the same doc_id and text have one hash and are taken or left together; the record at the threshold goes
where the sum comes nearer to the target; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NOT_WHITE, materialize, only, packed, unpacked

#: Bits of a histogram's buckets; two histograms are made, then hashes are summed as they are.
BITS, HASH_BITS = 12, 60
UPPER_SHIFT, LOWER_SHIFT = HASH_BITS - BITS, HASH_BITS - 2 * BITS


def record_hash():
    """60 bits of the md5 of doc_id and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(text))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def records(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and hash of every record."""
    size = F.coalesce(F.regexp_count("text", F.lit(NOT_WHITE)), F.lit(0)).cast("long")
    return only(docs, "doc_id", "text", "source").select("doc_id", "source", size.alias("size"), record_hash().alias("h"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size and target. sizes: source, source_size, a row for each source (a catalogue, not a corpus: its
    two sorts run in one task). Sources by code point, null last, weigh as in weights, repeated. What a source can't take
    beyond `most` times its size is shared again by weight: the level at which nothing is left over is found in closed form,
    over the sources by the level at which each is full."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    w = sizes.withColumn("w", weight.cast("long")).withColumn("full", F.col("source_size") * most)
    by_level = Window.orderBy(F.col("full") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("rest", F.sum("source_size").over(every) - F.coalesce(F.sum("full").over(before), F.lit(0))).withColumn("open", F.sum("w").over(after))
    # the first source, by level, that isn't filled sets the level; those after it have higher ones
    first = F.first(F.when(F.col("rest") * F.col("w") <= F.col("full") * F.col("open"), F.col("rest") / F.col("open")), True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return w.withColumn("level", first).select("source", "source_size", F.coalesce(F.least(F.col("full").cast("double"), F.col("level") * F.col("w")), F.col("full").cast("double")).alias("target"))


def _cut(sums: DataFrame, by: list[str], bucket: str) -> DataFrame:
    """Of (by, bucket, left, z): the bucket of each group in which the budget `left` ends, and what is left of it there."""
    upto = F.sum("z").over(Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0))
    return sums.withColumn("upto", upto).where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("z") <= F.col("left"))).select(*by, bucket, (F.col("left") - F.col("upto") + F.col("z")).alias("left"))


def thresholds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """source_id and threshold: the largest hash that is still taken once more. rows: source_id, size, h; plan: source_id, left."""
    upper, lower = F.shiftright("h", UPPER_SHIFT).alias("b1"), F.shiftright("h", LOWER_SHIFT).alias("b2")
    first = rows.groupBy("source_id", upper).agg(F.sum("size").alias("z")).join(plan, "source_id")
    cut1 = _cut(first, ["source_id"], "b1")
    second = rows.select("source_id", upper, lower, "size").join(cut1, ["source_id", "b1"]).groupBy("source_id", "b2", "left").agg(F.sum("size").alias("z"))
    cut2 = _cut(second, ["source_id"], "b2")
    last = rows.select("source_id", lower, "h", "size").join(cut2, ["source_id", "b2"]).groupBy("source_id", "b2", "left", "h").agg(F.sum("size").alias("z"))
    upto = F.sum("z").over(Window.partitionBy("source_id").orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    near = F.max(F.when(F.col("upto") - F.col("z") / 2 <= F.col("left"), F.col("h")))
    return last.withColumn("upto", upto).groupBy("source_id", "b2").agg(near.alias("at")).select("source_id", F.coalesce("at", F.shiftleft("b2", LOWER_SHIFT) - 1).alias("threshold"))


def _source_id():
    """A key that holds for a null source too."""
    return F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))


def limits(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source_id, source_size, target, whole (repeats of every record) and threshold of each source. rows: records()."""
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    left = F.col("target") - F.col("whole") * F.col("source_size")
    plan = materialize(plan.withColumn("whole", whole).select(_source_id().alias("source_id"), "source_size", "target", "whole", left.alias("left")), "plan")
    cuts = thresholds(rows.select(_source_id().alias("source_id"), "size", "h"), plan.select("source_id", "left").where("left > 0"))
    return materialize(plan.join(cuts, "source_id", "left").drop("left"), "limits")


def repeats():
    """How often the mix takes a record, given its hash and its source's limits."""
    return F.col("whole") + (F.col("h") <= F.coalesce("threshold", F.lit(-1))).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target, repeats (0 to `most`), h of every record."""
    rows = materialize(records(docs), "records")
    joined = rows.withColumn("source_id", _source_id()).join(limits(rows, weights, most), "source_id")
    return joined.select("doc_id", "source", "size", "source_size", "target", repeats().alias("repeats"), "h")


def repeated(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The rows of docs as often as the mix takes them, columns unchanged: a filter by hash, where they are read."""
    at = limits(materialize(records(docs), "records"), weights, most)
    joined = packed(docs, h=record_hash(), source_id=_source_id()).join(at, "source_id")
    return unpacked(joined.where(repeats() > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), repeats()))))


def op6_hash_threshold_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed with weights 1, 2, 3 and at most three repeats."""
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("repeats") * F.col("size")).alias("taken"))


ORACLE = {
    "op6_hash_threshold_mixing": r"""
WITH r AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM r GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, 3 * source_size AS full_size FROM s),
l AS (SELECT *, sum(source_size) OVER () - coalesce(sum(full_size) OVER (ORDER BY full_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(w) OVER (ORDER BY full_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w FROM w),
level AS (SELECT arg_min(rest::DOUBLE / open_w::DOUBLE, full_size / w) AS level FROM l WHERE rest * w <= full_size * open_w),
t AS (SELECT source, source_size, coalesce(least(full_size::DOUBLE, level * w), full_size::DOUBLE) AS target FROM w, level),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
c AS (SELECT source, h, sum(size) AS z FROM r GROUP BY source, h),
u AS (SELECT c.source, c.h, c.z, sum(c.z) OVER (PARTITION BY c.source ORDER BY c.h) AS upto FROM c),
k AS (SELECT u.source, max(CASE WHEN upto - z / 2 <= target - whole * source_size THEN h END) AS threshold FROM u JOIN p ON u.source IS NOT DISTINCT FROM p.source WHERE target - whole * source_size > 0 GROUP BY u.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN h <= coalesce(threshold, -1) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r JOIN p ON r.source IS NOT DISTINCT FROM p.source LEFT JOIN k ON r.source IS NOT DISTINCT FROM k.source""",
}
