"""Whole flows over small tables."""

from datetime import datetime, timedelta

from gazette.operators import enrich, selection, store
from gazette.plans import pipelines, text_queries, topic_queries
from gazette.sources import catalogue, feeds

from .test_feed_operators import NOW, articles
from .test_texts_and_pages import ATOM, RSS


def test_refresh_and_persist(spark):
    raw = spark.createDataFrame([("src0", RSS), ("src1", ATOM), ("src2", "broken")], "source_id string, payload string")
    page = spark.createDataFrame([("https://a.example/alt", "<article>" + "word " * 250 + "</article>")], "url string, html string")
    new = pipelines.refreshed(raw, catalogue.sample(spark), page, selection.Preferences())
    got = {r.title: r for r in new.collect()}
    assert set(got) == {"One & only", "Old", "Only a summary", "E"} and got["E"].content_source == "article_page" and got["E"].content_word_count == 250
    assert {r.title for r in pipelines.refreshed(raw, catalogue.sample(spark), page, None).collect()} == {"One & only", "Old", "Only a summary"}
    from gazette.schemas import ARTICLES

    empty = spark.createDataFrame([], ARTICLES)
    one = pipelines.persisted(empty, new, NOW)
    assert one.columns == empty.columns and one.count() == 4 and one.where("is_read or is_bookmarked").count() == 0
    marked = one.withColumn("is_read", one.is_bookmarked | True)
    two = pipelines.persisted(marked, new, NOW + timedelta(1))
    assert two.count() == 4 and two.where("is_read").count() == 4 and {r.created_at for r in two.collect()} == {NOW}
    assert pipelines.persisted(one, new.limit(0), NOW + timedelta(days=40)).count() == 0


def test_a_failed_write_never_fails_the_read(spark, tmp_path, monkeypatch):
    raw = spark.createDataFrame([("src0", RSS)], "source_id string, payload string")
    page, path = spark.createDataFrame([], "url string, html string"), str(tmp_path / "store")
    new, failed = pipelines.refreshed_and_kept(raw, catalogue.sample(spark), page, None, path, NOW)
    assert failed is None and new.count() == 3 and store.load(spark, path).count() == 3

    def full(*_):
        raise OSError("no space left")

    monkeypatch.setattr(store, "save", full)
    new, failed = pipelines.refreshed_and_kept(raw, catalogue.sample(spark), page, None, path, NOW)
    assert failed == "no space left" and new.count() == 3 and store.current_version(spark, path) == 1


def test_topics_and_picks(spark):
    rows = [{"id": k, "title": t, "source_id": f"s{k % 3}", "published_at": NOW - timedelta(hours=k % 5)} for k, t in enumerate(["Harbour bridge closes", "Harbour bridge reopens", "Budget vote tonight", "Harbour bridge inspection", "Football final"])]
    a, mains = articles(spark, rows), spark.createDataFrame([("s1",)], "id string")
    by_words = pipelines.topics_of_day(a, mains, NOW, None)
    assert sorted(len(r.member_ids) for r in by_words.collect()) == [0, 0, 2]
    by_provider = pipelines.topics_of_day(a, mains, NOW, None, enrich.Local())
    assert sorted(len(r.member_ids) for r in by_provider.collect()) == [0, 0, 0, 1]
    assert pipelines.topics_of_day(a, mains, NOW, None, enrich.Provider()).count() == by_words.count()
    cache = pipelines.saved_groups(by_words, NOW)
    again = pipelines.rehydrated_topics(cache, a, mains, NOW + timedelta(hours=11), None)
    assert sorted((r.lead_id, r.source_count) for r in again.collect()) == sorted((r.lead_id, r.source_count) for r in by_words.collect())
    assert pipelines.rehydrated_topics(cache, a, mains, NOW + timedelta(hours=13), None) is None
    stale = pipelines.topics(cache, a, mains, NOW + timedelta(hours=13), None)
    assert sorted(r.lead_id for r in stale.collect()) == sorted(r.lead_id for r in pipelines.topics_of_day(a, mains, NOW + timedelta(hours=13), None).collect())
    gone = pipelines.topics(cache, a.where("id > 3"), mains, NOW + timedelta(hours=1), None)
    assert [r.lead_id for r in gone.collect()] == [4] and pipelines.topics(cache, a, mains, NOW, None).where("is_aggregated").count() == 1
    picks = pipelines.for_you(a, ["bridge"], NOW, None, enrich.Local())
    assert [(r.id, r.relevance) for r in picks.collect()] == [(0, 40), (1, 40), (3, 40)] and pipelines.for_you(a, [], NOW, None, enrich.Local()).count() == 0
    saved = spark.createDataFrame([(0, 1, "x", 50, NOW), (1, 99, "x", 90, NOW)], "pos int, id long, interest string, relevance int, saved_at timestamp_ntz")
    assert [r.id for r in pipelines.rehydrated_picks(saved, a, NOW, None).collect()] == [1]
    assert pipelines.rehydrated_picks(saved, a, datetime(2027, 1, 1), None) is None
    assert [r.id for r in pipelines.shown(a, None, None).collect()] == [0, 1, 2, 3, 4][:5] and store.fresh_groups(cache, NOW).count() == 3


def test_refresh_of_whole_documents(spark, tmp_path, monkeypatch):
    texts = {k: f"begins {k} ]]> <b>\x01 " + "word " * 400 + f"ends {k}" for k in range(1, 10)}
    spark.createDataFrame([(k, t, "src1") for k, t in texts.items()], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    seen, whole = [], pipelines.refreshed
    monkeypatch.setattr(pipelines, "refreshed", lambda raw, catalogue, page_table, preferences: seen.append((raw, page_table)) or whole(raw, catalogue, page_table, preferences))
    assert topic_queries.home_refresh(spark, str(tmp_path)).count() == 9
    raw, page_table = seen[0]
    assert {r.url: r.html for r in page_table.collect()} == {f"https://src1.example/{k}": f"<article><p>{t}</p></article>" for k, t in texts.items()}
    assert sorted(i["summary"] for r in raw.collect() for i in feeds.parse(r.payload)) == sorted(t.replace("\x01", " ") for t in texts.values())


def test_jsonld_of_whole_pages(spark, tmp_path):
    html = '<p class="a">\\ \t\r\n\x02 é</p><script>x</script>' + "word " * 400 + "</p>"
    spark.createDataFrame([(k, "u", html) for k in (3, 4)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.page_id: (r.body, r.headline, r.is_free) for r in text_queries.jsonld_article(spark, str(tmp_path)).collect()} == {3: (html, "h", False), 4: (None, None, None)}
