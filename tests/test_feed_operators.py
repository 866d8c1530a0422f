"""Operators of the article store on small tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gazette.operators import dedup, query, ranking, reports, selection, store, topics
from gazette.schemas import CHECKS
from gazette.sources import catalogue, rules

NOW = datetime(2026, 4, 1, 12)
COLUMNS = "id long, pos long, title string, source_id string, source_name string, published_at timestamp_ntz, category string, tags array<string>, language string, is_bookmarked boolean, is_read boolean, created_at timestamp_ntz, updated_at timestamp_ntz, cleaned_content string, summary_short string, hero_image_url string, article_url string"


def articles(spark, rows):
    base = {"title": "t", "source_id": None, "source_name": "A", "published_at": NOW, "category": None, "tags": [], "language": None, "is_bookmarked": False, "is_read": False, "created_at": NOW, "updated_at": NOW, "cleaned_content": None, "summary_short": None, "hero_image_url": None, "article_url": None}
    full = [{**base, "pos": k, **r} for k, r in enumerate(rows)]
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], COLUMNS)


def ids(df):
    return [r.id for r in df.select("id").collect()]


def test_query(spark):
    a = articles(spark, [{"id": 1, "title": "Perché NO", "published_at": NOW - timedelta(days=1)}, {"id": 2, "cleaned_content": "un PERCHE qui", "source_name": "B", "is_bookmarked": True}, {"id": 3, "is_read": True}])
    assert ids(query.ArticleQuery(search=" perche ")(a)) == [2, 1] and ids(query.ArticleQuery(search="  ")(a)) == [2, 3, 1]
    assert ids(query.ArticleQuery(published_after=NOW)(a)) == [2, 3] and ids(query.ArticleQuery(published_before=NOW - timedelta(days=1))(a)) == [1]
    assert ids(query.ArticleQuery(source_names=[])(a)) == [] and ids(query.ArticleQuery(source_names=["B"])(a)) == [2] and ids(query.ArticleQuery(source_names=["b"])(a)) == []
    assert ids(query.ArticleQuery(only_unread=True, order="published_asc", limit=1)(a)) == [1] and ids(query.favourites(a)) == [2]
    assert ids(query.recent(a, 0)) == [2] and ids(query.by_id(a, 3)) == [3] and ids(query.ArticleQuery(limit=-1)(a)) == []


def test_sources(spark):
    c = catalogue.sample(spark, 12)
    assert selection.resolve_sources(c, None).count() == 3 and selection.resolve_sources(c, selection.Preferences()).count() == 12
    assert ids(selection.sources(c, "by_region", "italy")) == ["src0", "src6"] and ids(selection.sources(c, "by_region")) == []
    assert [r.region for r in selection.available_regions(c.limit(0), catalogue.regions(spark)).collect()] == []
    assert selection.allow_list(c, None) is None and selection.allow_list(c, selection.Preferences()) is None
    allow = selection.allow_list(c, selection.Preferences(enabled_regions=["italy"], hidden_sources=["src0"]))
    a = articles(spark, [{"id": 1, "source_id": "src6"}, {"id": 2, "source_id": "src0"}, {"id": 3, "source_name": "Outlet 06"}, {"id": 4, "source_id": "x", "source_name": "Outlet 06"}])
    assert sorted(ids(selection.allowed(a, allow))) == [1, 3] and sorted(ids(selection.denied(a, allow))) == [2, 4] and len(ids(selection.allowed(a, None))) == 4
    hidden = spark.createDataFrame([("OUTLET 06",)], "name string")
    assert sorted(ids(selection.without_hidden(a, hidden))) == [1, 2]
    row = spark.createDataFrame([(["a", "B"], ["b", "C"])], "x array<string>, y array<string>").select(selection.toggled(F.col("x"), "a").alias("off"), selection.toggled(F.col("x"), "z").alias("on"), selection.custom_interests(F.col("x"), F.col("y")).alias("own")).first()
    assert (row.off, row.on, row.own) == (["B"], ["a", "B", "z"], ["a"])


def test_dedup(spark):
    u = "https://a.example/x?utm_source=f&B=1#top"
    a = articles(spark, [{"id": 1, "article_url": u, "source_id": "s"}, {"id": 2, "article_url": "https://A.example/x?b=1", "source_id": "s"}, {"id": 3, "article_url": "https://a.example/x?b=1", "source_id": "r", "published_at": NOW + timedelta(1)}, {"id": 4, "source_id": "s", "published_at": None}]).withColumns({"region": F.lit("r"), "outlet_name": F.col("source_id")})
    assert sorted(ids(dedup.in_feed(a))) == [1, 3, 4] and sorted(ids(dedup.across_feeds(a))) == [3, 4]
    known = spark.createDataFrame([(k,) for k in "abcd"], "id string")
    groups = spark.createDataFrame([(0, 0, "a"), (0, 1, "ghost"), (1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "d"), (2, 1, "d")], "group_pos int, item_pos int, id string")
    assert sorted((r.group_pos, r.id) for r in dedup.first_use_groups(groups, known).collect()) == [(1, "b"), (1, "c"), (2, "d"), (2, "d")]
    picks = spark.createDataFrame([(0, "a", "x", 10), (1, "a", "x", 90), (2, "b", "y", 25), (3, "ghost", "y", 99)], "pos int, id string, interest string, relevance int")
    assert ids(dedup.first_use_picks(picks, known)) == ["b"]


def test_rank(spark):
    a = articles(spark, [{"id": 1, "tags": ["X", "x", "y"], "published_at": NOW}, {"id": 2, "source_name": "Fav"}, {"id": 3, "category": "Sport", "language": "IT"}, {"id": 4, "source_name": "Hid"}, {"id": 5, "published_at": NOW + timedelta(1)}])
    p = selection.Preferences(["sport"], ["x"], ["HID"], ["fav"], "it")
    got = ranking.rank(a, p).select("id", "score").collect()
    assert [(r.id, r.score) for r in got] == [(1, 4), (2, 4), (3, 4), (5, 0)]
    assert ids(ranking.rank(a, None)) == ids(ranking.rank(a, selection.Preferences())) == [1, 2, 3, 4, 5]


def test_caps_and_samples(spark):
    a = articles(spark, [{"id": k, "source_name": "A" if k < 8 else "B"} for k in range(10)])
    assert sorted(ids(ranking.capped(a, 3))) == [0, 1, 2, 8, 9] and ids(ranking.balanced(a, 5)) == [0, 8, 1, 9, 2] and ids(ranking.balanced(a, 10)) == list(range(10))
    got = {r.id: r.enriched for r in ranking.within_budget(a, F.col("id") % 2 == 1, 3).collect()}
    assert [k for k, v in got.items() if v] == [1, 3, 5, 9]
    p = spark.createDataFrame([(1, k, 10, c, n) for k, (c, n) in enumerate([(10, 1), (9, 1), (10, 1), (0, 0), (10, 1), (10, 1), (10, 2), (5, 1)])], "page_id int, pos int, chars int, link_chars int, links int")
    assert [r.pos for r in ranking.drop_link_runs(p).orderBy("pos").collect()] == [3, 4, 5, 6, 7]


def test_topics(spark):
    t = lambda h: NOW - timedelta(hours=h)
    a = articles(spark, [
        {"id": 1, "title": "Earthquake strikes coastal village overnight", "source_id": "m", "published_at": t(1)}, {"id": 2, "title": "Coastal village earthquake: rescue overnight", "source_id": "b", "published_at": t(2), "hero_image_url": "i"},
        {"id": 3, "title": "Rescue after coastal earthquake in village", "source_id": "c", "published_at": t(3)}, {"id": 4, "title": "Parliament passes budget", "source_id": "d", "published_at": t(0)},
        {"id": 5, "title": "Earthquake strikes coastal village overnight", "source_id": "e", "published_at": t(25)}, {"id": 6, "title": "Earthquake coastal village", "published_at": NOW + timedelta(seconds=301)}, {"id": 7, "title": "", "source_id": "f", "published_at": t(4)},
    ])
    mains = spark.createDataFrame([("m",)], "id string")
    got = [(r.lead_id, r.member_ids, r.source_count, r.is_aggregated, r.pos) for r in topics.aggregate(a, mains, NOW).orderBy("pos").collect()]
    assert got == [(2, [1, 3], 3, True, 1), (4, [], 1, False, 2), (7, [], 1, False, 3)]
    groups = spark.createDataFrame([(0, 1), (0, 3), (1, 5), (1, 4), (2, 99), (2, 4)], "group_pos int, id long")
    got = [(r.lead_id, r.member_ids, r.source_count) for r in topics.from_groups(groups, a, mains, NOW).orderBy("pos").collect()]
    assert got == [(1, [3], 2), (6, [], 1), (4, [], 1), (2, [], 1), (7, [], 1)]
    assert topics.aggregate(a.limit(0), mains, NOW).count() == 0


def test_large_clusters_are_dealt_out(spark):
    rows = spark.range(6000).select("id", F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("source_id"), F.lit("A").alias("source_name"), (F.lit(NOW) - F.make_dt_interval(secs=F.col("id") % 50)).cast("timestamp_ntz").alias("published_at"), F.when(F.col("id") == 4320, "i").alias("hero_image_url"))
    rows = rows.withColumn("cluster", F.when(F.col("id") % 3 == 0, "big").otherwise(F.col("id").cast("string")))
    mains = spark.createDataFrame([("s1",)], "id string")
    held = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # four ranges, however small
    try:
        for gather in (True, False):
            out = topics.build(rows, mains, gather)
            plan = out._jdf.queryExecution().toString()
            assert "SinglePartition" not in plan and "collect_list" not in plan and ("member_ids" in out.columns) == gather
            got = out.orderBy("pos").collect()
            assert [r.pos for r in got] == list(range(1, 4002)) and (got[0].lead_id, got[0].source_count, got[0].is_aggregated) == (4320, 7, True)
            main, late = (lambda i: i % 7 != 1), (lambda i: i % 50)
            assert [r.lead_id for r in got[1:]] == sorted((i for i in range(6000) if i % 3), key=lambda i: (main(i), late(i), i))
            if gather:
                assert got[0].member_ids == sorted((i for i in range(0, 6000, 3) if i != 4320), key=lambda i: (late(i), i)) and not any(r.member_ids for r in got[1:])
        large = topics.gathered(rows.select("cluster", (F.col("id") % 50).alias("late"), "id"))
        assert large.where("cluster = 'big'").select(F.size("all")).first()[0] == 2000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", held)


def folded(order, pairs):
    """Greedy clusters by going through the articles one after another."""
    near, of, first = {}, {}, {}
    for a, b, x in pairs:
        near.setdefault(a, []).append((b, x))
        near.setdefault(b, []).append((a, x))
    for i in order:
        best = {}
        for j, x in near.get(i, ()):
            if j in of:
                best[of[j]] = max(best.get(of[j], 0), x)
        of[i] = max(best, key=lambda c: (best[c], -c)) if best else len(first)
        first.setdefault(of[i], i)
    return {i: first[c] for i, c in of.items()}


def test_greedy_takes_the_best_cluster(spark):
    """Chains, cliques of equal similarity, and random graphs with many ties, against a fold."""
    import random

    rng, n = random.Random(4), 120
    chain = [(k, k + 1, 0.5) for k in range(39)]
    clique = [(a, b, 1.0) for a in range(40, 60) for b in range(a + 1, 60)]
    wild = [(a, b, rng.choice([0.3, 0.4, 0.4, 0.9])) for a in range(60, n) for b in range(a + 1, n) if rng.random() < 0.08]
    pairs = [(0, 39, 0.4), (20, 59, 0.7), *chain, *clique, *wild]
    minutes = {k: rng.randrange(30) for k in range(n)}  # many at the same time
    for dates in (minutes, {k: k for k in range(n)}):
        a = articles(spark, [{"id": k, "published_at": NOW - timedelta(minutes=dates[k])} for k in range(n)])
        got = {r.id: r.cluster for r in topics.greedy(a, spark.createDataFrame(pairs, "a long, b long, similarity double")).collect()}
        assert got == folded(sorted(range(n), key=lambda k: (dates[k], k)), pairs)
    none = topics.greedy(a, spark.createDataFrame([], "a long, b long, similarity double"))
    assert {r.id: r.cluster for r in none.collect()} == {k: k for k in range(n)}


def test_long_lists_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(topics, "LIST", 4)
    rows = [(k, "all", 1.0 + k, 0.1 * k) for k in range(50)] + [(k, "few", 2.0, 0.0) for k in (3, 9)]
    got = topics.met_in_blocks(spark.createDataFrame(rows, "id long, token string, u double, slack double")).collect()
    want = [(a, b, (1.0 + a) * (1.0 + b), 0.1 * a, 0.1 * b) for a in range(50) for b in range(a + 1, 50)] + [(3, 9, 4.0, 0.0, 0.0)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_similar_pairs_loses_nothing(spark):
    import random

    rng = random.Random(1)
    rows = [(k, f"t{t}", w) for k in range(60) for t, w in {rng.randrange(25): rng.uniform(0.1, 3) for _ in range(6)}.items()]
    got = {(r.a, r.b): r.similarity for r in topics.similar_pairs(spark.createDataFrame(rows, "id long, token string, weight double")).collect()}
    vec = {}
    for i, t, w in rows:
        vec.setdefault(i, {})[t] = w
    norm = {i: sum(w * w for w in v.values()) ** 0.5 for i, v in vec.items()}
    want = {}
    for a in vec:
        for b in vec:
            s = sum(w * vec[b].get(t, 0) for t, w in vec[a].items()) / norm[a] / norm[b]
            if a < b and s >= 0.3:
                want[a, b] = s
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_story(spark):
    rows = [(1, k, f"s{k}", "t", "x" * 1500, None) for k in range(12)] + [(2, 0, "s", "t", None, "short")]
    got = {r.cluster: r.story for r in topics.story_input(spark.createDataFrame(rows, "cluster int, place int, source_name string, title string, cleaned_content string, summary_short string")).collect()}
    assert got[2] == "SOURCE: s\nTITLE: t\nshort" and got[1].count("SOURCE") == 9 and got[1].count("x") <= 10_000


def test_store(spark, tmp_path):
    later = NOW + timedelta(1)
    old = articles(spark, [{"id": 1, "is_bookmarked": True, "source_id": "s"}, {"id": 2}])
    new = articles(spark, [{"id": 1, "title": "new", "created_at": later}, {"id": 3, "title": "three"}]).select(*old.columns)
    got = {r.id: r for r in store.upsert(old, new, later).collect()}
    assert got[1].title == "new" and got[1].is_bookmarked and got[1].source_id == "s" and got[1].created_at == NOW and got[1].updated_at == later and got[2].updated_at == NOW and got[3].title == "three"
    once = store.upsert(old, new, later)
    assert sorted(map(tuple, store.upsert(once, new, later).drop("tags").collect())) == sorted(map(tuple, once.drop("tags").collect()))
    path = str(tmp_path / "t")
    assert store.current_version(spark, path) is None
    store.save(old, path)
    store.save(once, path)
    assert store.current_version(spark, path) == 2 and store.load(spark, path).count() == 3
    a = articles(spark, [{"id": 1, "created_at": NOW - timedelta(days=31)}, {"id": 2, "created_at": NOW - timedelta(days=31), "is_bookmarked": True}, {"id": 3, "created_at": NOW - timedelta(days=30)}, {"id": 4, "created_at": NOW - timedelta(days=8)}])
    assert sorted(ids(store.retained(a, NOW))) == [2, 3, 4] and sorted(ids(store.retained(a, NOW, 7))) == [2]
    log = spark.createDataFrame([("i1", 1, "bookmark_toggle", NOW), ("i2", 1, "bookmark_toggle", later), ("i3", 1, "open", NOW), ("i4", 3, "bookmark_toggle", NOW), ("i5", 3, "mark_read", later), ("i6", 9, "mark_read", later), ("i7", 3, "mark_read", NOW)], "id string, article_id long, action_type string, ts timestamp_ntz")
    state = {r.article_id: r.is_bookmarked for r in store.bookmark_state(log).collect()}
    assert state == {1: False, 3: True} and store.without_history(log).count() == 6
    after = {r.id: (r.is_bookmarked, r.is_read) for r in store.with_events(a, log).collect()}
    assert after == {1: (False, True), 2: (True, False), 3: (True, True), 4: (False, False)}
    assert [(r.article_id, r.ts) for r in store.read_interactions(log.where("action_type = 'mark_read'"), a).collect()] == [(3, NOW)]
    good, bad = selection.existing(log, a)
    assert good.count() == 6 and [r.id for r in bad.collect()] == ["i6"]
    opens = spark.createDataFrame([(1, NOW, 3.0, 0.5), (8, NOW, None, None)], "article_id long, ts timestamp_ntz, reading_duration double, scroll_depth double")
    kept, lost = store.recorded_opens(opens, a)
    assert kept.count() == 1 and lost.count() == 1 and query.history(kept, 5).count() == 1
    assert store.patched({"a": 1}, {"a": None}) == ({"a": 1}, False) and store.patched({"a": 1}, {"b": ["x", "x"]}) == ({"a": 1, "b": ["x"]}, True)
    cache = spark.createDataFrame([(1, NOW), (2, NOW - timedelta(hours=13)), (3, later)], "id long, saved_at timestamp_ntz")
    assert ids(store.fresh_groups(cache, NOW)) == [1]


def test_store_survives_a_writer_that_dies(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "t"), articles(spark, [{"id": 1}])
    store.save(rows, path)
    more = articles(spark, [{"id": 1}, {"id": 2}])

    def dies(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:  # between the data and the pointer
        m.setattr(type(spark), "createDataFrame", dies)
        with pytest.raises(OSError):
            store.save(more, path)
    assert store.current_version(spark, path) == 1 and store.load(spark, path).count() == 1
    for n in (2, 3, 4):
        store.save(more, path)
        assert store.current_version(spark, path) == n and store.load(spark, path).count() == 2
    from pathlib import Path

    assert len(list(Path(path, "data").iterdir())) == 3  # two versions and what the dead writer left


def test_batches_are_merged_by_id(spark, tmp_path):
    from gazette.streaming import events

    path, failed = str(tmp_path / "t"), []
    batch = articles(spark, [{"id": 1, "title": "old"}, {"id": 1, "title": "new", "published_at": NOW + timedelta(hours=1)}, {"id": 2}])
    write = events.merge_into(path, NOW)
    write(batch, 0)
    write(batch, 1)
    got = sorted((r.id, r.title) for r in store.load(spark, path).collect())
    assert [i for i, _ in got] == [1, 2] and got[0][1] == "new"
    events.surviving(write, failed)(batch.drop("title"), 2)
    assert len(failed) == 1 and failed[0].startswith("batch 2: ") and store.load(spark, path).count() == 2


def test_preferences_are_kept(spark, tmp_path):
    path = str(tmp_path / "p")
    assert store.load_preferences(spark, path) == store.DEFAULTS and store.current_version(spark, path) == 1
    assert store.update_preferences(spark, path, {"preferred_language": None}) == store.DEFAULTS and store.current_version(spark, path) == 1
    assert store.update_preferences(spark, path, {"hidden_sources": ["b", "a", "b"], "preferred_language": "it"})["hidden_sources"] == ["b", "a"]
    assert store.load_preferences(spark, path)["preferred_language"] == "it" and store.current_version(spark, path) == 2
    assert store.reset_preferences(spark, path) == store.DEFAULTS and store.load_preferences(spark, path) == store.DEFAULTS


def test_purge(spark):
    allow = selection.allow_list(catalogue.sample(spark), selection.Preferences(hidden_sources=["src1"]))
    a = articles(spark, [{"id": 1, "source_id": "src1"}, {"id": 2, "source_id": "src1", "is_bookmarked": True}, {"id": 3, "source_name": "Outlet 02"}, {"id": 4, "source_name": "Outlet 01"}])
    kept, gone = store.purge_disabled(a, allow)
    assert sorted(ids(kept)) == [2, 3] and sorted(ids(gone)) == [1, 4] and store.purge_disabled(a, None)[1].count() == 0


def test_reports(spark):
    rows = [("a", "A", "r", True, "u", "success", 4, 1, 4, 9, None), ("b", "B", "r", False, "u", "success", 4, 2, 2, 9, None), ("c", "C", "q", False, "u", "parse_failed", 0, 0, 0, 9, 'x "y"\n'), ("d", "D", "q", False, "u", "odd", 0, 0, 0, 9, None)]
    c = spark.createDataFrame(rows, CHECKS)
    assert [r.source_id for r in reports.degraded(c).collect()] == ["a"] and reports.outcome(c).first().outcome == "loaded" and reports.outcome(c.where("status <> 'success'")).first().outcome == "failed" and reports.outcome(c.limit(0)).first().outcome == "empty"
    assert {r.bucket: r.feeds for r in reports.by_status(c).collect()} == {"success": 2, "failed": 2}
    lines = [r.value for r in reports.text_report(c).collect()]
    assert lines[0] == '[failed] C (q) articles=0 images=0 bodies=0 9ms "x \\"y\\"\\n"' and '"status":"success"' in reports.json_report(c).collect()[2].value


def test_rules(spark):
    text = '{"rules": [{"id": "a", "hosts": ["Example.com."], "strip_text_patterns": ["ok", "("]}, {"id": "b", "hosts": ["news.example.com"]}, {"hosts": []}]}'
    known = rules.load(text)
    assert [r["id"] for r in known] == ["a", "b"] and known[0]["strip_text_patterns"] == ["ok"] and rules.load("{") == [] and rules.load("3") == []
    hosts = spark.createDataFrame([("www.example.com",), ("x.news.example.com",), ("badexample.com",), ("example.com",), (None,)], "host string")
    got = {r.host: r.rule_id for r in rules.for_hosts(hosts, rules.table(spark, known)).collect()}
    assert got == {"www.example.com": "a", "x.news.example.com": "b", "badexample.com": None, "example.com": "a", None: None}


def files(path):
    """Files of rows and deletes of a bucketed table."""
    return {str(f.relative_to(path)) for kind in ("data", "deletes") for f in (path / kind).rglob("*.parquet")}


def test_bucketed_store(spark, tmp_path):
    """A small batch leaves all other files as they are; deletes write keys only; compaction rewrites what they touched."""
    from gazette.operators import buckets

    path, later = tmp_path / "t", NOW + timedelta(1)
    old = articles(spark, [{"id": k, "title": f"t{k}", "created_at": NOW - timedelta(days=k % 60), "is_bookmarked": k % 10 == 0, "source_id": "s"} for k in range(400)]).withColumn("content_source", F.lit("article_page"))
    buckets.create(old, str(path), 32)
    rows = lambda: {r.id: r for r in buckets.load(spark, str(path)).collect()}
    assert len(rows()) == 400 and buckets.load(spark, str(path)).columns == old.columns
    before = files(path)
    batch = articles(spark, [{"id": k, "title": "new", "source_id": None, "is_bookmarked": True} for k in (1, 2, 3, 1000)]).withColumn("content_source", F.lit("none"))
    touched = buckets.merge(batch, str(path), later, "store")
    after = files(path)
    assert 1 <= len(touched) <= 4 and before < after and {f.split("/")[2] for f in after - before} == {f"bucket={b}" for b in touched}
    got = rows()
    assert len(got) == 401 and got[1].title == "new" and got[1].content_source == "article_page" and got[1].source_id == "s" and not got[1].is_bookmarked and got[1].updated_at == later and got[1000].is_bookmarked and got[4].title == "t4"
    want = {r.id: r for r in store.upsert(old, batch, later, "store").collect()}
    assert got == want
    assert buckets.merge(batch.limit(0), str(path), later) == [] and files(path) == after
    with pytest.raises(ValueError):
        buckets.merge(batch.unionByName(batch), str(path), later)
    buckets.merge(batch, str(path), later, "article")
    assert rows()[1].content_source == "none"
    data = {f for f in files(path) if f.startswith("data")}
    gone = buckets.enforce_retention(spark, str(path), NOW, 30)
    assert gone == sum(k % 60 > 30 and k % 10 != 0 and k not in (1, 2, 3) for k in range(400)) and {f for f in files(path) if f.startswith("data")} == data
    kept = set(rows())
    assert len(kept) == 401 - gone and buckets.enforce_retention(spark, str(path), NOW, 30) == 0
    assert buckets.delete(spark.createDataFrame([(0,), (0,), (99999,)], "id long"), str(path)) == 1 and 0 not in rows()
    again = articles(spark, [{"id": 0, "title": "back"}]).withColumn("content_source", F.lit("none"))
    buckets.merge(again, str(path), later)
    assert rows()[0].title == "back" and set(rows()) == kept
    content = rows()
    assert buckets.compact(spark, str(path)) and rows() == content and buckets.compact(spark, str(path)) == []
    assert buckets.vacuum(spark, str(path), 1) > 0 and rows() == content and not {f for f in files(path) if f.startswith("deletes")}
    # a writer that died before it named its manifest leaves the table as it was
    buckets._written(batch, str(path), "data", 32, "id")
    assert rows() == content
    empty = tmp_path / "e"
    buckets.create(old.limit(0), str(empty), 4)
    assert buckets.load(spark, str(empty)).count() == 0 and buckets.merge(batch, str(empty), later) and buckets.load(spark, str(empty)).count() == 4
    keyless = articles(spark, [{"id": None, "title": "none"}]).withColumn("content_source", F.lit("none"))
    buckets.merge(keyless, str(empty), later)
    buckets.merge(keyless, str(empty), later)
    assert buckets.load(spark, str(empty)).count() == 5 and buckets.purge_disabled(spark, str(empty), None) == 0


def test_similar_pairs_meet_in_places_of_two_groups(spark, monkeypatch):
    """Every pair meets once, in whatever groups, copies and text ids too, and pairs aren't shuffled by what they add up to."""
    monkeypatch.setattr(topics, "GROUP", 7)
    rows = [(f"d{k}", t, 1.0) for k in range(60) for t in ("all", f"t{k % 3}", f"u{k % 5}")] + [("alone", "x", 2.0)]
    found = topics.similar_pairs(spark.createDataFrame(rows, "id string, token string, weight double"), 0.5)
    shared = lambda a, b: 1 + (a % 3 == b % 3) + (a % 5 == b % 5)
    want = sorted((*sorted((f"d{a}", f"d{b}")), round(shared(a, b) / 3, 9)) for a in range(60) for b in range(a) if shared(a, b) > 1)
    assert sorted((r.a, r.b, round(r.similarity, 9)) for r in found.collect()) == want
    assert "HashAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_vectors_read_texts_once(spark):
    """Counts are a table of their own, so frequencies, weights, norms and vectors don't tokenize every text again."""
    rows = articles(spark, [{"id": k, "title": f"solar storm {k % 2} report", "summary_short": "solar wind"} for k in range(4)])
    weights = topics.vectors(rows)
    assert "Generate" not in weights._jdf.queryExecution().executedPlan().toString()
    assert {(r.id, r.token): round(r.weight, 6) for r in weights.collect()}[0, "solar"] == 2.0


def test_similar_pairs_complete_few_pairs(spark):
    """A place is a task, and only pairs whose products come near the threshold are looked up, however many share a common token."""
    import numpy as np

    from gazette.functions import cosines

    rows = [(k, t, w) for k in range(90) for t, w in (("all", 0.29), (f"pair{k // 2}", 0.2), (f"own{k}", 1.0), (f"other{k}", 1.0))]
    found = topics.similar_pairs(spark.createDataFrame(rows, "id long, token string, weight double"), 0.05)
    assert found.rdd.getNumPartitions() == topics.GROUPS * (topics.GROUPS + 1) // 2
    norm = 0.29**2 + 0.2**2 + 2.0
    assert sorted((r.a, r.b, round(r.similarity, 9)) for r in found.collect()) == [(k, k + 1, round((0.29**2 + 0.2**2) / norm, 9)) for k in range(0, 90, 2)]
    n, one = 50, np.ones(50)
    t = np.stack([np.zeros(n, int), 1 + np.arange(n) // 2, 26 + np.arange(n)], 1).ravel()
    entries = (np.arange(0, 3 * n + 1, 3), t, np.tile([0.09, 0.3, 0.949], n), np.tile([True, False, False], n), 0.09 * one, 26 + n)
    x, none = cosines.Side(np.arange(n), *entries), cosines.Side(np.arange(0), *entries)
    assert sum(len(i) for i, _, _ in cosines.able(x, x, True, 0.098)) == n // 2
    assert [(i.tolist(), j.tolist(), np.round(c, 9).tolist()) for i, j, c in cosines.similar(x, x, True, 0.098)] == [(list(range(0, n, 2)), list(range(1, n, 2)), [round(0.09**2 + 0.3**2, 9)] * (n // 2))]
    assert not sum(len(i) for i, _, _ in (*cosines.similar(x, none, False, 0.098), *cosines.similar(none, x, False, 0.098)))
