import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyspark.llm import neardup, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark):
    docs = corpus_pipeline.table(spark, SF, "documents")
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.Workspace(spark).save(stage(spark, docs, SF), name)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        if name in ("toxicity", "near_duplicates", "decontamination"):
            assert 0.5 * n < out.count() <= docs.count()
        if name == "near_duplicates":
            assert neardup.near_duplicates(out).where("n_links > 0").isEmpty()
        docs = out
    assert {"shard", "slot"} <= set(docs.columns)
    shards = docs.groupBy("shard").count().collect()
    assert max(r["count"] for r in shards) - min(r["count"] for r in shards) <= 1


def test_rows_without_id_or_text_pass(spark):
    docs = spark.createDataFrame([(None, "words without an id", "en", "a", 1), (1, None, "en", None, 0), (2, "", "en", "a", 0), (3, "twice the same row", "en", "a", 1), (3, "twice the same row", "en", "a", 1)], SCHEMA)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept) == [("1", ""), ("2", ""), ("3", "twice the same row"), ("None", "words without an id")]
    assert corpus_pipeline.drop_leaks(spark, docs, SF).count() == 5


def test_clashing_columns_and_empty_tables(spark):
    """Columns named as those that the stages add stay as they are; an empty table gives an empty one."""
    extra = ("id", "text_hash", "copies", "copy", "score", "predicted", "place", "Source_size", "same", "hit")
    docs = corpus_pipeline.table(spark, SF, "documents").where("doc_id < 40").withColumns({c: F.lit("mine") for c in extra})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and not out.isEmpty()
        assert out.where(" or ".join(f"{c} <> 'mine'" for c in extra)).isEmpty()
        assert stage(spark, docs.where("false"), SF).isEmpty()
    helpers = ("__h", "__slice", "__rank", "__Text_crc32", "__law", "__arc")
    sharded = corpus_pipeline.shard(spark, docs.withColumns({c: F.lit("mine") for c in helpers}), SF)
    assert sharded.where(" or ".join(f"{c} <> 'mine'" for c in (*extra, *helpers))).isEmpty() and sharded.count() == docs.count()
    assert corpus_pipeline.shard(spark, docs.where("false"), SF).isEmpty()


def test_planted_documents_against_brute_force(spark):
    """A copy, a near copy and a benchmark passage go, one of each group stays, clean documents stay."""
    texts = [r["text"] for r in corpus_pipeline.table(spark, SF, "documents").where("n_chars > 400 and doc_id % 3 = 0").orderBy("doc_id").limit(12).collect()]
    item = corpus_pipeline.table(spark, SF, "benchmark").where("size(split(text, ' ')) >= 12").orderBy("item_id").first()["text"]
    longest = max(texts, key=len).split(" ")
    rows = [(10_000 + i, t) for i, t in enumerate(texts)] + [(20_000, texts[0]), (20_001, " ".join([*longest[:-1], "changed"])), (20_002, f"A note of its own, then {item} and an end.")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], SCHEMA)

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))}

    kept = []
    for i, t in rows:  # ids ascend, so the first of a group is its least
        if not any(len(shingles(t) & shingles(u)) >= 0.8 * len(shingles(t) | shingles(u)) for _, u in kept):
            kept.append((i, t))
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()) == [i for i, _ in kept]
    leaks = {r["id"] for r in corpus_pipeline.decontaminate.find_leaks(docs, corpus_pipeline.table(spark, SF, "benchmark")).where("n_hit > 0").collect()}
    assert 20_002 in leaks
    assert {r["doc_id"] for r in corpus_pipeline.drop_leaks(spark, docs, SF).collect()} == {i for i, _ in rows} - leaks
    sizes = {i: len(t.split()) for i, t in rows}
    mixed = [r["doc_id"] for r in corpus_pipeline.mix(spark, docs, SF).collect()]
    assert set(mixed) <= set(sizes) and max(map(mixed.count, mixed)) <= 2
    assert abs(sum(sizes[i] for i in mixed) - 1.5 * sum(sizes.values())) <= max(sizes.values())
    labels = corpus_pipeline.table(spark, SF, "labels")
    whole = corpus_pipeline.table(spark, SF, "documents")
    want = toxicity.score_toxicity(whole, toxicity.fit(whole, labels)).where("predicted = 0").select("doc_id")
    assert sorted(r[0] for r in want.collect()) == sorted(r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, whole, SF).collect())
