"""The corpus pipeline: toxicity, near-duplicates, benchmark leaks, source weights, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it and reads it again for the next
stage. Filters give back the columns of documents. Rows without an id pass the near-duplicate stage; texts that
are null or empty are neither toxic, near-duplicates nor leaks, but the mix takes no document without words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm import decontaminate, mixing, neardup, sharding, toxicity
from tallyspark.llm._work import Workspace, fresh, passing, small, table


def keyed(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """docs joined with keys (id, text_hash, perhaps source and more, under names of their own) by those columns."""
    names = dict(zip(keys.columns, fresh(docs.columns, *keys.columns), strict=True))
    keys = keys.withColumnsRenamed(names)
    same = F.col("`doc_id`").eqNullSafe(F.col(f"`{names['id']}`")) & (F.xxhash64("`text`") == F.col(f"`{names['text_hash']}`"))
    if "source" in names:
        same = same & F.col("`source`").cast("string").eqNullSafe(F.col(f"`{names['source']}`"))
    return docs.join(small(keys), same, how)


def columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, does not reject."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score_of(F.col("`text`"), model) < toxicity.REJECT_AT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least (id, text hash) of each group of near-duplicates; of rows equal in id and text, the
    least by their other columns."""
    work = Workspace(spark)
    found = work.save(neardup.near_duplicates(docs), "near")
    dropped = found.where("class_id <> id or class_hash <> text_hash").select("id", "text_hash").distinct()
    kept = keyed(docs, work.save(dropped, "dropped"), "left_anti")
    repeated = work.save(found.groupBy("id", "text_hash").agg(F.count("*").alias("c")).where("c > 1").select("id", "text_hash"), "repeated")
    if repeated.isEmpty():
        return kept
    others = [c for c, kind in docs.dtypes if not kind.startswith("map")]
    first = Window.partitionBy("`doc_id`", F.xxhash64("`text`")).orderBy(*[F.col(f"`{c}`") for c in others])
    (place,) = fresh(docs.columns, "place")
    least = keyed(kept, repeated, "left_semi").withColumn(place, F.row_number().over(first)).where(f"{place} = 1")
    return keyed(kept, repeated, "left_anti").unionByName(least.select(*columns(docs)))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    leaks = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0").select("id", "text_hash")
    return keyed(docs, Workspace(spark).save(leaks, "leaks"), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice."""
    taken = Workspace(spark).save(mixing.mix_sources(docs).where("copies > 0").select("id", "text_hash", "source", "copies"), "taken")
    copies, copy = fresh(docs.columns, "id", "text_hash", "source", "copies", "copy")[3:]
    chosen = keyed(docs, taken, "inner")
    return chosen.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(f"`{copies}`").cast("int")))).select(*columns(docs))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shards and slots."""
    return sharding.shard_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix),
    ("sharding", shard),
]

#: A fitted classifier and MinHash retrieval have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work = table(spark, sf_dir, "documents"), Workspace(spark)
    for k, (name, stage) in enumerate(STAGES):
        with passing(spark):  # what a stage wrote on its way goes once its result is written
            docs = work.save(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            work.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
