"""Each stage of the pipeline on what the one before kept, against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gazette.llm import mixing, quality
from gazette.llm.common import shared_dir

from .test_models import VOCAB, brute_groups
from .test_native import BENCH, TAKEN, brute2, size, words6


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, at = random.Random(11), tmp_path_factory.mktemp("sf")
    rows = []
    for k in range(400):
        w = [rng.choice(VOCAB) for _ in range(rng.randrange(30, 120))]
        bad = k % 5 == 0
        text = " | ".join(w).upper() + "!!" if bad else ". ".join(" ".join(w[a : a + 9]).capitalize() for a in range(0, len(w), 9)) + "."
        rows.append((k, text, f"s{k % 3}" if k % 2 else "hot"))
    good = [r for r in rows if r[0] % 5]
    rows += [(1000 + k, r[1] + (" End." if k % 2 else ""), "hot") for k, r in enumerate(good[:60])]
    rows += [(2000 + k, f"{good[k][1]} {BENCH}.", None) for k in range(100, 120)] + [(3000, None, "s1"), (3001, "", None), (None, good[99][1][:200], "s2"), (None, None, None), (7, rows[7][1], "s1")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, int(k % 5 != 0), 0) for k in range(0, 400, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, BENCH), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), docs


def rows_of(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def test_stages(spark, tables):
    at, docs = tables
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = rows_of(docs)
        out = stage(spark, docs, at)
        path = f"{shared_dir(spark)}/test-{name}"
        out.write.mode("overwrite").parquet(path)
        after_df = spark.read.parquet(path)
        if name != "sharding":
            assert after_df.columns == columns
            after = rows_of(after_df)
        if name == "quality":
            score = {r.doc_id: r.score for r in quality.scored(docs, spark.read.parquet(f"{at}/labels.parquet")).collect() if r.doc_id is not None}
            assert Counter(r for r in after if r[0] is not None) == Counter(r for r in before if r[0] is not None and score[r[0]] >= 0.3)
            assert not [r for r in after if r[0] is not None and r[0] < 400 and r[0] % 5 == 0] and len([r for r in after if r[0] is not None and r[0] < 400]) >= 318
        elif name == "near_duplicates":
            groups = brute_groups([(i, t) for i, t, _ in before], 5, 80)
            want = {c for _, n, c in groups if n and c is not None}
            assert sorted(i for i, t, _ in after if words6(t) and i is not None) == sorted(want)
            assert Counter(r for r in after if not words6(r[1])) == Counter(r for r in before if not words6(r[1]))
        elif name == "decontamination":
            bad = [i for i, *_, dirty in brute2(before, [(1, BENCH)]) if dirty]
            assert bad and sorted(map(repr, after)) == sorted(repr(r) for r in before if r[0] not in bad)
        elif name == "mixing":
            times = Counter()
            for r in mixing.mix(docs).collect():
                times[r.doc_id] += r.repeats
            assert Counter(r[0] for r in after) == +times and set(after) <= set(before)
        else:
            got = after_df.collect()
            assert Counter((r.doc_id, r.size) for r in got) == Counter((i, size(t)) for i, t, _ in before)
            for s in range(8):
                assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
        docs, kept[name] = after_df, len(before)
    assert kept["sharding"] > 0 and corpus_pipeline.run(spark, at).count() == docs.count()


def test_further_columns_of_any_name_pass_through(spark, tables, tmp_path):
    at, docs = tables
    names = [f"{under}{n}" for n in TAKEN for under in ("", "_")]
    wide = docs.select("*", *[F.concat_ws("-", F.lit(c), F.col("doc_id").cast("string"), F.md5("text")).alias(c.upper()) for c in names])
    wide.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{at}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    before = {tuple(r) for r in wide.collect()}
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = corpus_pipeline.materialize(stage(spark, rows, str(tmp_path)), name)
        assert rows.columns == wide.columns and {tuple(r) for r in rows.collect()} <= before
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == corpus_pipeline.run(spark, at).count() == rows.count()
