"""Sharding by fixed virtual slots: a record hashes into one of thousands of slots for good; bytes are summed by slot; a
versioned table maps slots to shards, is kept under a path of the caller's, and is edited, slot by slot, when shards are added
or loads drift.

The law is `bytes`: shard sizes near equal. A record's slot comes from its doc_id, its text and, where a record occurs more
than once, from which copy it is; so copies spread over slots, whatever share of all rows they are, and no slot is hot. Copies
are numbered in two levels: within a block of rows of one file, then by the counts of the blocks before it.

The map has as many rows as there are slots (a parameter, 4096 unless said), so it is broadcast and folded in one row whatever
the corpus weighs; record tables are grouped by slot only, and no task holds more than one slot's narrow rows at a time.

Defined results: a null text weighs 1 byte; repeated rows share no slot but by chance; which of equal rows has which place is
open, as nothing tells them apart; an empty table gives an empty result and a map that deals slots out in turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, only, scratch

SLOTS = 4096
#: Rows of a file in which copies are numbered at once.
COPIES = 1 << 16


def described(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and key (hash of doc_id and text) of each record."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return only(docs, "doc_id", "text").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.xxhash64("doc_id", text, F.octet_length(text)).alias("key"))


def numbered(stored: DataFrame) -> DataFrame:
    """stored, a table read from Parquet, with `copy`: 0, 1, ... among the records of the same key."""
    block = F.struct(F.col("_metadata.file_path").alias("file"), F.floor(F.col("_metadata.row_index") / COPIES).alias("part"))
    rows = stored.select("doc_id", "size", "text_crc32", "key", block.alias("block"))
    again = stored.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("key")
    once = stored.select("doc_id", "size", "text_crc32", "key").join(again, "key", "left_anti").withColumn("copy", F.lit(0).cast("long"))
    more = rows.join(again, "key", "left_semi")
    before = F.sum("n").over(Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    first = more.groupBy("key", "block").agg(F.count(F.lit(1)).alias("n")).select("key", "block", F.coalesce(before, F.lit(0)).alias("first"))
    here = F.row_number().over(Window.partitionBy("key", "block").orderBy("doc_id")) - 1
    return once.unionByName(more.withColumn("here", here).join(first, ["key", "block"]).select("doc_id", "size", "text_crc32", "key", (F.col("first") + F.col("here")).cast("long").alias("copy")))


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and the virtual slot of each record."""
    slot = F.pmod(F.when(F.col("copy") == 0, F.col("key")).otherwise(F.xxhash64("key", "copy")), F.lit(slots)).cast("int")
    return numbered(materialize(described(docs), "described")).select("doc_id", "size", "text_crc32", slot.alias("vslot"))


def slot_bytes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Bytes and rows of every slot, empty ones included."""
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    summed = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    return every.join(F.broadcast(summed), "vslot", "left").select("vslot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("n", F.lit(0)).alias("n"))


def new_map(stats: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """Version 1 of the map: slots by falling bytes, each to the shard that has least so far (the lowest number on ties).
    The fold runs over one array with an entry for each slot."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("neg"), "vslot", "n")))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("load"), F.array().cast("array<struct<vslot:int,shard:int>>").alias("dealt"))

    def step(acc, x):
        to = F.array_position(acc["load"], F.array_min(acc["load"])).cast("int")
        load = F.transform(acc["load"], lambda v, i: F.when(i == to - 1, v - x["neg"]).otherwise(v))
        return F.struct(load.alias("load"), F.concat(acc["dealt"], F.array(F.struct(x["vslot"].alias("vslot"), (to - 1).alias("shard")))).alias("dealt"))

    return stats.agg(F.aggregate(order, start, step)["dealt"].alias("dealt")).select(F.inline("dealt")).select(F.lit(version).alias("version"), "vslot", "shard")


def rebalance(old: DataFrame, stats: DataFrame, shards: int) -> DataFrame:
    """The next version for so many shards: a shard keeps its slots up to an even share of all bytes and gives up the rest
    (all, if it is closed); slots given up go, largest first, to the shard with least. Other slots stay where they are."""
    now = old.join(F.broadcast(stats), "vslot")
    share = (stats.agg(F.sum("bytes")).first()[0] or 0) / shards
    kept = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(Window.unboundedPreceding, 0))
    marked = now.withColumn("stays", (F.col("shard") < shards) & (kept <= F.lit(share)))
    row = F.struct((-F.col("bytes")).alias("neg"), "vslot", "shard", "stays")
    rows = marked.agg(F.max("version").alias("version"), F.array_sort(F.collect_list(row)).alias("rows"))
    loads = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.aggregate(F.filter("rows", lambda r: r["stays"] & (r["shard"] == s)), F.lit(0).cast("long"), lambda a, r: a - r["neg"]))
    start = F.struct(loads.alias("load"), F.array().cast("array<struct<vslot:int,shard:int>>").alias("dealt"))

    def step(acc, x):
        to = F.array_position(acc["load"], F.array_min(acc["load"])).cast("int")
        load = F.transform(acc["load"], lambda v, i: F.when(i == to - 1, v - x["neg"]).otherwise(v))
        return F.struct(load.alias("load"), F.concat(acc["dealt"], F.array(F.struct(x["vslot"].alias("vslot"), (to - 1).alias("shard")))).alias("dealt"))

    moved = F.aggregate(F.filter("rows", lambda r: ~r["stays"]), start, step)["dealt"]
    stayed = F.transform(F.filter("rows", lambda r: r["stays"]), lambda r: F.struct(r["vslot"].alias("vslot"), r["shard"].alias("shard")))
    return rows.select((F.col("version") + 1).alias("version"), F.inline(F.concat(stayed, moved)))


def save_map(slot_map: DataFrame, path: str) -> None:
    """Keep a version of the map under path; a version once kept can't be written again."""
    version = slot_map.agg(F.max("version")).first()[0]
    slot_map.select("vslot", "shard").coalesce(1).write.mode("error").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the map kept under path, the newest unless said."""
    kept = spark.read.schema("version int, vslot int, shard int").parquet(path)
    version = kept.agg(F.max("version")).first()[0] if version is None else version
    return kept.where(F.col("version") == version).select("version", "vslot", "shard")


def shard(docs: DataFrame, shards: int = 8, slots: int = SLOTS, slot_map: DataFrame | None = None, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (the record's place in its shard, 0 to rows - 1), vslot and the map's version.
    slot_map: a version to place records by; without one, version 1 is made from the slots' bytes and kept under map_path
    (a new folder among the intermediate tables unless said)."""
    rows = materialize(records(docs, slots), "records")
    stats = materialize(slot_bytes(rows, slots).coalesce(1), "slot_bytes")
    if slot_map is None:
        map_path = map_path or scratch(docs.sparkSession, "slot_map")
        save_map(new_map(stats, shards), map_path)
        slot_map = load_map(docs.sparkSession, map_path)
    # places within a shard: slots follow one another, so only a slot's own rows are sorted together
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1))
    placed = slot_map.join(F.broadcast(stats), "vslot").select("version", "vslot", "shard", F.coalesce(before, F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32")) - 1
    return rows.withColumn("place", place).join(F.broadcast(placed), "vslot").select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("place")).cast("long").alias("slot"), "vslot", "version")


def op1_virtual_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 by the `bytes` law."""
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", F.col("version").alias("map_version"))
