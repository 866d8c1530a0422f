"""Topics: TF-IDF vectors, similar pairs, greedy clusters, clusters from given groups, leads and order."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.functions import cosines, text, times
from gazette.operators.ranking import source_key
from gazette.sources.tables import materialize

WINDOW_SECONDS, SKEW_SECONDS, THRESHOLD = 86_400, 300, 0.30
#: Rounds grow with the logarithm of the longest chain; so many are never needed.
MOST_ROUNDS = 100
#: Rows of a token's list that meet at once.
LIST = 256
#: Articles of a group, of which every two meet in a place, and the least number of groups.
GROUP, GROUPS = 32_768, 8
#: Share of the threshold that the tokens which an article leaves out may reach.
LEFT_OUT = 1 / 3


def _seconds(column: str | Column) -> Column:
    return F.unix_micros((F.col(column) if isinstance(column, str) else column).cast("timestamp")) / 1_000_000


def windowed(articles: DataFrame, as_of: datetime, upper: bool = True) -> DataFrame:
    """Articles of the day before as_of; those up to five minutes after it too, or, with upper=False, all after it."""
    at = times.at(as_of)
    out = articles.where(F.col("published_at") >= at - F.expr(f"interval {WINDOW_SECONDS} seconds"))
    return out.where(F.col("published_at") <= at + F.expr(f"interval {SKEW_SECONDS} seconds")) if upper else out


def vectors(articles: DataFrame) -> DataFrame:
    """id, token, weight: tf * (ln(N / df) + 1). A row for each token, so that joins can be dealt by token."""
    words = articles.select("id", F.explode(text.tokens(F.col("title"), F.col("summary_short"))).alias("token"))
    # texts are read once: what is made of the counts reads them from a table
    tf = materialize(words.groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf")), "tf")
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    total = articles.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    return tf.join(df, "token").select("id", "token", (F.col("tf") * (F.log(F.lit(float(total)) / F.col("df")) + 1)).alias("weight"))


def met_in_blocks(rows: DataFrame) -> DataFrame:
    """a, b (a < b), dot, sa, sb of every two rows (id, token, u, slack) of a token. A token's list is cut into blocks of some
    LIST rows by a hash of the id, and blocks meet in pairs, each pair in a place of its own; so a token that a tenth of all
    articles have is many small products, not one task's."""
    long = rows.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / LIST).cast("int").alias("many")).where("many > 1")
    dealt = rows.join(long, "token", "left").withColumn("many", F.coalesce("many", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("many")).cast("int"))
    x = dealt.select("token", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("many") - 1)).alias("j"), F.col("id").alias("xi"), F.col("u").alias("xu"), F.col("slack").alias("xs"))
    y = dealt.select("token", F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), F.col("id").alias("yi"), F.col("u").alias("yu"), F.col("slack").alias("ys"))
    met = x.join(y, ["token", "i", "j"]).where("i < j or xi < yi")
    first = F.col("xi") < F.col("yi")
    side = lambda of, other: F.when(first, F.col(of)).otherwise(F.col(other))
    return met.select(side("xi", "yi").alias("a"), side("yi", "xi").alias("b"), (F.col("xu") * F.col("yu")).alias("dot"), side("xs", "ys").alias("sa"), side("ys", "xs").alias("sb"))


def similar_pairs(weights: DataFrame, least: float = THRESHOLD) -> DataFrame:
    """a, b (a < b), similarity: cosines of `least` or more, from equal tokens. Common tokens would make most of the products, so
    every article leaves out, commonest first, as many of its tokens as can't reach LEFT_OUT of `least` by themselves: their share of
    a cosine is at most their length, and at most the sum of their weights times each token's greatest weight anywhere. As all leave
    out in one order of tokens, what a pair shares outside of the rest is left out by whichever of both leaves out more: a pair whose
    other tokens fall short by more than the larger share of both is none; the others are completed. The less is left out, the more
    products there are and the fewer pairs to complete. Articles are dealt by a hash of the id into groups of some GROUP, every two
    groups meet in a place of their own, a task each, and so does a pair of articles: what its tokens add up to is summed there and is
    shuffled nowhere."""
    norms = weights.groupBy("id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    unit = materialize(weights.join(norms, "id").select("id", "token", (F.col("weight") / F.col("norm")).alias("u")), "unit")
    stats = unit.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.max("u").alias("most"))
    stats = materialize(stats.withColumn("t", F.monotonically_increasing_id()), "tokens")
    common = Window.partitionBy("id").orderBy(F.desc("df"), "token").rowsBetween(Window.unboundedPreceding, 0)
    bound = F.least(F.sqrt(F.sum(F.col("u") * F.col("u")).over(common)), F.sum(F.col("u") * F.col("most")).over(common))
    marked = unit.join(stats, "token").withColumn("upto", bound).withColumn("rest", F.col("upto") < least * LEFT_OUT)
    whole = marked.groupBy("id").agg(F.collect_list(F.struct("t", "u", "rest")).alias("v"), F.coalesce(F.max(F.when(F.col("rest"), F.col("upto"))), F.lit(0.0)).alias("slack"))
    whole = materialize(whole, "whole")
    many = max(GROUPS, -(-whole.count() // GROUP))
    own = F.pmod(F.xxhash64("id"), F.lit(many)).cast("int")
    dealt = whole.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    place = F.expr("j * (j + 1) div 2 + i").cast("int")
    dealt = dealt.withColumns({"i": i, "j": j}).select(place.alias("place"), (F.col("i") == F.col("j")).alias("same"), (F.col("own") <= F.col("other")).alias("first"), "id", "slack", *[F.col(f"v.{c}").alias(c) for c in ("t", "u", "rest")])
    kind = weights.schema["id"].dataType.simpleString()
    dealt = dealt.repartitionById(many * (many + 1) // 2, "place").sortWithinPartitions("place")
    return dealt.mapInArrow(lambda batches: cosines.of_places(batches, least), f"a {kind}, b {kind}, similarity double")


def greedy(articles: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, cluster. Newest first, an article joins the cluster with its most similar member, or starts one; equal similarities go to
    the older cluster; cluster is the id of the article that started it.

    No fold is needed: an article's cluster is that of its most similar earlier neighbour, or, of several equally similar ones, the
    oldest of theirs. With an edge from each article to those neighbours, its cluster is thus the earliest article that it reaches,
    as that one has no edge itself. Each round takes the least of what an article's neighbours, and the least so far, reach; rounds
    grow with the logarithm of a chain's length, not with a cluster's size, and each is written."""
    order = F.struct((-F.unix_micros(F.col("published_at").cast("timestamp"))).alias("late"), F.col("id").alias("who"))
    turn = articles.select("id", order.alias("turn"))
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "similarity").unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other"), "similarity"))
    earlier = both.join(turn, "id").join(turn.select(F.col("id").alias("other"), F.col("turn").alias("least")), "other").where("least < turn")
    nearest = earlier.withColumn("top", F.max("similarity").over(Window.partitionBy("id"))).where("similarity = top")
    edges = materialize(nearest.select("id", F.col("other").alias("to"), "least"), "edges")
    reach, before = materialize(edges.groupBy("id").agg(F.min("least").alias("least")), "reach0"), None
    for k in range(1, MOST_ROUNDS + 1):
        now = reach.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("id", "least"))).first()
        if now == before or not now[0]:
            break
        if k == MOST_ROUNDS:
            raise RuntimeError(f"greedy: clusters still change after {k} rounds")
        before = now
        further = reach.select(F.col("id").alias("to"), F.col("least").alias("further"))
        steps = edges.select("id", "to").unionByName(reach.select("id", F.col("least.who").alias("to")))
        found = steps.join(further, "to").select("id", F.col("further").alias("least"))
        reach = materialize(reach.unionByName(found).groupBy("id").agg(F.min("least").alias("least")), f"reach{k}")
    return turn.join(reach, "id", "left").select("id", F.coalesce("least.who", "id").alias("cluster"))


def numbered(rows: DataFrame, *order: str | Column) -> DataFrame:
    """rows with pos, from 1: sorted in ranges, each of which begins after the rows of those before it. The driver sees a number
    for each range."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    kept = materialize(dealt, "order")
    part = F.shiftright("_at", 33).cast("int")
    begins, total = {}, 0
    for r in kept.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        begins[r["part"]] = total
        total += r["n"]
    start = F.element_at(F.array(*[F.lit(begins.get(k, 0)).cast("long") for k in range(max(begins, default=0) + 1)]), part + 1)
    return kept.withColumn("pos", (start + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("int")).drop("_at")


def gathered(rows: DataFrame) -> DataFrame:
    """cluster, all: ids of (cluster, late, id) by late and id. Members are sorted in ranges, so a large cluster is packed in
    several tasks, and the last one only joins their runs."""
    dealt = rows.select("cluster", "late", "id").repartitionByRange("cluster", "late", "id").withColumn("part", F.spark_partition_id())
    runs = dealt.groupBy("cluster", "part").agg(F.array_sort(F.collect_list(F.struct("late", "id"))).alias("run"))
    packed = runs.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("part", F.transform("run", lambda x: x["id"]).alias("run")))).alias("runs"))
    return packed.select("cluster", F.flatten(F.transform("runs", lambda x: x["run"])).alias("all"))


def build(members: DataFrame, mains: DataFrame, gather: bool = True) -> DataFrame:
    """lead_id, member_ids (newest first; only with gather), source_count, is_aggregated, pos of each cluster. members: articles
    with `cluster`; mains: id of main outlets. Lead: with an image, then of a main outlet, then the newest. Order: sources, main
    lead, newest lead, id."""
    main = mains.select(F.col("id").alias("_main")).distinct()
    rows = members.join(main, F.col("source_id") == F.col("_main"), "left")
    grade = F.when(F.col("hero_image_url").isNull(), 2).otherwise(0) + F.when(F.col("_main").isNull(), 1).otherwise(0)
    late = -F.unix_micros(F.col("published_at").cast("timestamp"))
    rows = rows.select("cluster", grade.alias("grade"), late.alias("late"), "id", source_key().alias("source"))
    rows = materialize(rows, "members") if gather else rows
    out = rows.groupBy("cluster").agg(F.min(F.struct("grade", "late", "id")).alias("lead"), F.count(F.lit(1)).alias("n"), F.countDistinct("source").cast("int").alias("source_count"))
    ids = []
    if gather:
        out = out.join(gathered(rows).withColumnRenamed("cluster", "_cluster"), F.col("cluster").eqNullSafe(F.col("_cluster")))
        ids = [F.filter("all", lambda x: x != F.col("lead.id")).alias("member_ids")]
    out = out.select(F.col("lead.id").alias("lead_id"), *ids, "source_count", (F.col("n") > 1).alias("is_aggregated"), (F.col("lead.grade") % 2).alias("_side"), F.col("lead.late").alias("_late"))
    return numbered(out, F.desc("source_count"), "_side", "_late", "lead_id").drop("_side", "_late")


def aggregate(articles: DataFrame, mains: DataFrame, as_of: datetime) -> DataFrame:
    """Topic clusters of the articles of the last day."""
    recent = materialize(windowed(articles, as_of), "recent")
    assigned = greedy(recent, materialize(similar_pairs(materialize(vectors(recent), "vectors")), "pairs"))
    return build(recent.join(assigned, "id"), mains)


def grouped_articles(groups: DataFrame, articles: DataFrame) -> DataFrame:
    """Articles with `cluster`: those of given groups (group_pos, id) with two or more articles, then all others alone."""
    found = articles.join(groups.select("group_pos", F.col("id").alias("_gid")), F.col("id") == F.col("_gid")).drop("_gid")
    large = found.groupBy("group_pos").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").select(F.col("group_pos").alias("_large"))
    kept = found.join(large, F.col("group_pos").eqNullSafe(F.col("_large")), "left_semi")
    alone = articles.join(kept.select(F.col("id").alias("_kid")), F.col("id") == F.col("_kid"), "left_anti")
    return kept.withColumn("cluster", F.concat(F.lit("g"), F.col("group_pos").cast("string"))).drop("group_pos").unionByName(alone.withColumn("cluster", F.concat(F.lit("a"), F.col("id").cast("string"))))


def from_groups(groups: DataFrame, articles: DataFrame, mains: DataFrame, as_of: datetime) -> DataFrame:
    """Clusters of given groups over articles no older than a day."""
    return build(grouped_articles(groups, windowed(articles, as_of, False)), mains)


def story_input(members: DataFrame, each: int = 1_200, total: int = 10_000) -> DataFrame:
    """cluster, story: members (cluster, place, source_name, title, cleaned_content, summary_short) in order as blocks, each
    with at most `each` characters of text, until the blocks have `total` characters."""
    body = F.coalesce("cleaned_content", "summary_short", F.lit(""))
    # texts are cut, and members beyond those that empty blocks would leave room for go, before any are gathered
    most = -(-total // len("SOURCE: \nTITLE: \n"))
    place = F.row_number().over(Window.partitionBy("cluster").orderBy("place"))
    rows = members.withColumn("_turn", place).where(F.col("_turn") <= most).select("cluster", F.struct("place", F.col("source_name").alias("source"), "title", F.substring(body, 1, each).alias("body")).alias("m"))
    gathered = rows.groupBy("cluster").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    start = F.struct(F.lit(total).alias("left"), F.array().cast("array<string>").alias("blocks"))

    def step(acc, m):
        block = F.concat(F.lit("SOURCE: "), F.coalesce(m["source"], F.lit("")), F.lit("\nTITLE: "), F.coalesce(m["title"], F.lit("")), F.lit("\n"), F.substring(m["body"], F.lit(1), F.greatest(F.lit(0), acc["left"])))
        return F.struct(F.when(acc["left"] > 0, acc["left"] - F.length(block)).otherwise(acc["left"]).alias("left"), F.when(acc["left"] > 0, F.concat(acc["blocks"], F.array(block))).otherwise(acc["blocks"]).alias("blocks"))

    return gathered.select("cluster", F.array_join(F.aggregate("ms", start, step)["blocks"], "\n\n---\n\n").alias("story"))
