"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, probed by every token window of the corpus.

Texts are lower-cased (A-Z) and cut into words of digits, letters and all that isn't ASCII. A window is 13 consecutive words
of an item; an item of fewer words is one window. Every corpus window that holds some window's anchor (its longest word) in
that word's place is hashed, the hash is looked up, and a hit is verified word by word; only hits and one row a document
leave the scan.

The set of windows is broadcast while the benchmark weighs at most `broadcast_bytes`; beyond that, corpus windows go out as
places and hashes, of fixed size each, to meet it by a shuffle (and AQE splits hot windows), and texts are looked at again only
where a hash was met. Both ways give the same rows.

Defined results: null and empty texts have no words, no hits and aren't contaminated; an item without words has no window;
equal items all count; an item without item_id hits words like any other, but is in no list of items; repeated rows each get a row;
an empty benchmark hits nothing. Rows that stay keep all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, only, packed, unpacked

WINDOW = 13
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What separates words before lower-casing.
GAP = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NO_WORD, -1), "")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, n, hash, said (the window's words joined by spaces), each once an item."""
    w = only(benchmark, "item_id", "text").select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).withColumn("n", F.least(F.lit(window), F.size("w")))
    at = F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1))
    cut = w.select("item_id", "n", "w", at.alias("pos")).select("item_id", "n", F.slice("w", F.col("pos"), F.col("n")).alias("part"))
    return cut.select("item_id", "n", F.xxhash64(F.transform("part", lambda x: F.xxhash64(x))).alias("hash"), F.array_join("part", " ").alias("said")).distinct()


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Per document: doc_id, text_hash, n_words, hits (sorted (pos, end) of the windows that occur, positions from 1, end exclusive), items
    (sorted item_ids as strings), n_hit."""
    found = materialize(benchmark_windows(benchmark, window), "windows")
    weight = found.agg(F.sum(F.octet_length("said") + 32)).first()[0]
    distinct = found.select("n", "hash", "said").distinct()
    # a window is looked up where its anchor, its longest word, stands: a word has few places that it may have in a window
    longest = F.array_sort(F.transform(F.split("said", " "), lambda w: F.struct((-F.length(w)).alias("less"), w.alias("w"))))[0]["w"]
    at = F.array_position(F.split("said", " "), F.col("anchor")).cast("int") - 1
    anchors = distinct.withColumn("anchor", longest).withColumn("off", at).groupBy("anchor").agg(F.collect_set(F.struct("off", "n")).alias("places"))
    small = (weight or 0) <= broadcast_bytes
    distinct, anchors = (F.broadcast(x) if small else x for x in (distinct, anchors))

    text = F.coalesce(F.col("text"), F.lit(""))
    base = only(docs, "doc_id", "text").select("doc_id", F.xxhash64(text, F.length(text)).alias("text_hash"), words(F.col("text")).alias("w"))
    per = at_anchors(base, anchors, distinct) if small else by_hash(base, distinct)
    per = materialize(per, "hits")
    owners = found.groupBy("said").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    owners = F.broadcast(owners) if small else owners
    items = per.where(F.size("saids") > 0).select("doc_id", "text_hash", F.explode("saids").alias("said")).join(owners, "said").groupBy("doc_id", "text_hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"))
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))
    merged = F.aggregate("hits", zero, lambda a, h: F.struct(F.greatest(a["upto"], h["end"]).alias("upto"), (a["n"] + F.greatest(F.lit(0), h["end"] - F.greatest(a["upto"], h["pos"]))).alias("n")))
    clean = per.where(F.size("saids") == 0).withColumn("items", F.array().cast("array<string>"))
    dirty = per.where(F.size("saids") > 0).join(items.withColumnsRenamed({"doc_id": "i_doc", "text_hash": "i_hash"}), F.col("doc_id").eqNullSafe(F.col("i_doc")) & (F.col("text_hash") == F.col("i_hash"))).select(*clean.columns)
    out = clean.unionByName(dirty).withColumn("n_hit", merged["n"].cast("long"))
    return out.select("doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"), "hits", "items", "n_hit", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")).drop("copy")


def at_anchors(base: DataFrame, anchors: DataFrame, distinct: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_words, times (rows of the same doc_id and text), hits, saids of each document of base (doc_id,
    text_hash, w), by broadcast tables of anchors and windows."""
    # the document itself is a word of its own, '', at 0
    every = base.select("doc_id", "text_hash", F.size("w").alias("n_words"), "w", F.posexplode(F.concat(F.array(F.lit("")), "w")).alias("i", "word"))
    own = F.array(F.struct(F.lit(0).alias("off"), F.lit(0).alias("n")))
    marked = every.join(anchors, F.col("word") == F.col("anchor"), "left").where(F.col("anchor").isNotNull() | (F.col("i") == 0))
    tried = marked.select("doc_id", "text_hash", "n_words", "w", "i", F.explode(F.when(F.col("i") == 0, own).otherwise(F.col("places"))).alias("place"))
    tried = tried.select("doc_id", "text_hash", "n_words", "w", (F.col("i") - F.col("place.off")).alias("pos"), F.col("place.n").alias("wn")).where((F.col("pos") == 0) & (F.col("wn") == 0) | (F.col("pos") >= 1) & (F.col("pos") + F.col("wn") - 1 <= F.col("n_words")))
    part = F.slice("w", F.greatest("pos", F.lit(1)), F.col("wn"))
    hit = tried.join(distinct, (F.xxhash64(F.transform(part, lambda x: F.xxhash64(x))) == F.col("hash")) & (F.col("wn") == F.col("n")) & (F.array_join(part, " ") == F.col("said")), "left")
    hit = hit.where(F.col("said").isNotNull() | (F.col("pos") == 0)).select("doc_id", "text_hash", "n_words", "pos", (F.col("pos") + F.col("wn")).alias("end"), "said")
    # windows to items: the benchmark's own size bounds both sides of a document
    return hit.groupBy("doc_id", "text_hash", "n_words").agg(
        F.count_if(F.col("pos") == 0).alias("times"),
        F.array_sort(F.collect_set(F.when(F.col("said").isNotNull(), F.struct("pos", "end")))).alias("hits"),
        F.collect_set("said").alias("saids"),
    )


def by_hash(base: DataFrame, distinct: DataFrame) -> DataFrame:
    """The same by a shuffle: what goes out is a row of fixed size for each window of each document."""
    lengths = sorted(r.n for r in distinct.select("n").distinct().collect())  # WINDOW of them at most
    keys = base.groupBy("doc_id", "text_hash", F.size("w").alias("n_words")).agg(F.count(F.lit(1)).alias("times"))
    if not lengths:
        return keys.select("*", F.array().cast("array<struct<pos:int,end:int>>").alias("hits"), F.array().cast("array<string>").alias("saids"))
    hashed = base.select("doc_id", "text_hash", F.transform("w", lambda x: F.xxhash64(x)).alias("hs")).dropDuplicates(["doc_id", "text_hash"])

    def at(n: int) -> Column:
        places = F.when(F.size("hs") >= n, F.sequence(F.lit(1), F.size("hs") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda p: F.struct(p.alias("pos"), F.lit(n).alias("wn"), F.xxhash64(F.slice("hs", p, F.lit(n))).alias("h")))

    sent = hashed.select("doc_id", "text_hash", F.explode(F.concat(*map(at, lengths))).alias("x")).select("doc_id", "text_hash", "x.*")
    met = sent.join(distinct, (F.col("h") == F.col("hash")) & (F.col("wn") == F.col("n"))).select(F.col("doc_id").alias("m_doc"), F.col("text_hash").alias("m_hash"), F.struct("pos", (F.col("pos") + F.col("wn")).alias("end"), "said").alias("x"))
    met = met.groupBy("m_doc", "m_hash").agg(F.array_sort(F.collect_set("x")).alias("met"))
    same = F.col("doc_id").eqNullSafe(F.col("m_doc")) & (F.col("text_hash") == F.col("m_hash"))
    true = F.filter("met", lambda x: F.array_join(F.slice("w", x["pos"], x["end"] - x["pos"]), " ") == x["said"])
    sure = base.join(met.hint("shuffle_hash"), same).select("m_doc", "m_hash", true.alias("met")).dropDuplicates(["m_doc", "m_hash"])
    pair = F.array_sort(F.array_distinct(F.transform(F.coalesce("met", F.array().cast("array<struct<pos:int,end:int,said:string>>")), lambda x: F.struct(x["pos"].alias("pos"), x["end"].alias("end")))))
    saids = F.array_distinct(F.transform(F.coalesce("met", F.array().cast("array<struct<pos:int,end:int,said:string>>")), lambda x: x["said"]))
    return keys.join(sure, same, "left").select("doc_id", "text_hash", "n_words", "times", pair.alias("hits"), saids.alias("saids"))


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words", share: int = 20) -> Column:
    """A twentieth of the words, or more, is hit."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * share >= F.col(n_words))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW) -> DataFrame:
    """The rows of docs without contamination, columns unchanged. remove="documents": contaminated documents go.
    remove="spans": documents stay, without the words in any occurrence of a window and what stands between such words."""
    found = scan(docs, benchmark, window)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = packed(docs, doc=F.col("doc_id"), hash=F.xxhash64(text, F.length(text)))
    bad = found.where(contaminated() if remove == "documents" else "n_hit > 0").groupBy("doc_id", "text_hash").agg(F.first("hits").alias("hits")).withColumnsRenamed({"doc_id": "bad_doc", "text_hash": "bad_hash"})
    on = F.col("doc").eqNullSafe(F.col("bad_doc")) & (F.col("hash") == F.col("bad_hash"))
    if remove == "documents":
        bad = materialize(bad.drop("hits"), "contaminated")  # its size is known before texts are joined
        return unpacked(keyed.join(bad, on, "left_anti"))
    said = F.col("row.text")
    pieces = F.regexp_extract_all(said, F.lit(f"[^{GAP}]+|[{GAP}]+"), F.lit(0))
    lead = F.when(said.rlike(f"^[^{GAP}]"), 0).otherwise(1)  # the place of the first word
    even = lambda i: (i - F.col("lead")) % 2 == 0
    first = lambda i: F.floor((i - F.col("lead")) / 2).cast("int") + 1  # noqa: E731  the word at i, or the one before the gap at i
    gone = lambda i: F.exists("hits", lambda h: (h["pos"] <= first(i)) & (h["end"] > F.when(even(i), first(i)).otherwise(first(i) + 1)))
    kept = F.array_join(F.filter("pieces", lambda p, i: ~gone(i)), "")
    out = keyed.join(bad, on, "left").withColumn("lead", lead).withColumn("pieces", F.when(F.col("hits").isNotNull(), pieces))
    return unpacked(out, F.when(F.col("hits").isNotNull(), kept).otherwise(said))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside benchmark windows, the items hit, and the verdict."""
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


ORACLE = {
    "op2_benchmark_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bn AS (SELECT *, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS said FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM bn)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT k, i, n, array_to_string(w[i:i + n - 1], ' ') AS said FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT DISTINCT k, i, n FROM dw SEMI JOIN bw USING (n, said)),
wh AS (SELECT k, count(DISTINCT i + j) AS n_hit FROM (SELECT k, i, unnest(range(0, n)) AS j FROM hit) GROUP BY k),
it AS (SELECT k, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM dw JOIN bw USING (n, said) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN wh USING (k) LEFT JOIN it USING (k)""",
}
