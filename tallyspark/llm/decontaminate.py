"""Benchmark decontamination by winnowing.

Of every run of `window` words, the k-gram of least hash is a fingerprint, k being about half the window. A
passage of `window` words has the same fingerprint in a document and in an item, so joining the fingerprints
finds every document that shares such a passage. Around each joined fingerprint the hit is then extended to
whole windows, which are compared as text: hashes only choose what is compared.

Items shorter than a window are one window of their own length; their only fingerprint is the whole item.
Of the corpus, only keys, word counts and documents that joined travel; texts are not shuffled otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._work import Workspace, ascii_lower, let, small, table

WINDOW, GRAM = 10, 5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def grams(hashes: Column, k: int) -> Column:
    """Hash of each k consecutive words, in order."""
    return F.transform(F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (k - 1), F.lit(0))), lambda x, i: F.xxhash64(F.lit(k), x, *[F.get(hashes, i + j) for j in range(1, k)]))


def winnow(hashes: Column, k: int, window: int) -> Column:
    """The distinct fingerprints: minima of k-gram hashes over each run of `window` words."""
    span = window - k + 1
    return let(grams(hashes, k), lambda g: F.array_distinct(F.transform(F.slice(g, F.lit(1), F.greatest(F.size(g) - (span - 1), F.lit(0))), lambda x, i: F.least(x, *[F.get(g, i + j) for j in range(1, span)]))))


def fingerprints(words: Column, short: list[int], k: int, window: int) -> Column:
    """All fingerprints to look up: of full windows, and whole runs as long as the short items."""
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.concat(winnow(h, k, window), *[F.array_distinct(grams(h, n)) for n in short]))


# Spark counts the parameters of a function, defaults too; so these bind n outside.
def whole(n: int):
    return lambda h: grams(h, n)


def of_length(n: int):
    return lambda p: p["n"] == n


def windows_at(words: Column, starts: Column, n: int) -> Column:
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.lit(n).alias("n"), F.array_join(F.slice(words, s + 1, F.lit(n)), " ").alias("window")))


def all_windows(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, windows_at(words, F.sequence(F.lit(0), F.size(words) - n), n)).otherwise(F.array().cast("array<struct<start:int,n:int,window:string>>"))


def find_leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = GRAM) -> DataFrame:
    """One row for each key (id, text_hash) of docs: id, text_hash, n_rows, n_words, n_hit, items (array of strings).

    Rows that repeat id and text are one key with n_rows of them. Null ids and null item ids are kept (the
    latter as empty strings), null and wordless texts have no words; they hit nothing.
    """
    spark = docs.sparkSession
    work = Workspace(spark)
    read = work.save(items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words_of(F.col(item_text)).alias("words")).where(F.size("words") > 0), "items")
    short = sorted(r[0] for r in read.where(F.size("words") < window).select(F.size("words")).distinct().collect())  # below window, so few
    own = F.concat(all_windows(F.col("words"), window), *[F.when(F.size("words") == n, all_windows(F.col("words"), n)).otherwise(F.array().cast("array<struct<start:int,n:int,window:string>>")) for n in short])
    windows = work.save(read.select("item", F.explode(own).alias("w")).select("w.window", "item").distinct(), "windows")
    long_items, short_items = read.where(F.size("words") >= window), read.where(F.size("words") < window)
    hashed = lambda c: F.transform(c, lambda w: F.xxhash64(w))
    prints = long_items.select(F.explode(let(hashed(F.col("words")), lambda h: winnow(h, k, window))).alias("fp"), F.lit(window).alias("n"))
    for n in short:
        prints = prints.unionByName(short_items.where(F.size("words") == n).select(F.explode(let(hashed(F.col("words")), whole(n))).alias("fp"), F.lit(n).alias("n")))
    prints = work.save(prints.distinct(), "prints")
    look_up = small(prints.select("fp", F.lit(1).alias("hit")).distinct(), prints)

    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), words_of(F.col(text_col)).alias("words"))
    seen = keyed.select("id", "text_hash", F.size("words").cast("long").alias("n_words"), F.posexplode_outer(fingerprints(F.col("words"), short, k, window)).alias("at", "fp"))
    is_row = (F.coalesce("at", F.lit(0)) == 0).cast("long")
    keys = work.save(seen.join(look_up, "fp", "left").groupBy("id", "text_hash", "n_words").agg(F.sum(is_row).alias("n_rows"), F.max("hit").alias("hit")), "keys")

    chosen = keys.where("hit = 1").select(F.col("id").alias("cid"), F.col("text_hash").alias("chash"))
    same = F.col("id").eqNullSafe(F.col("cid")) & (F.col("text_hash") == F.col("chash"))
    found = work.save(keyed.join(small(chosen), same, "left_semi").dropDuplicates(["id", "text_hash"]), "found")
    empty = F.array().cast("array<struct<fp:bigint,pos:int,n:int>>")
    tagged = lambda h, g, n: F.when(F.size(h) >= n, F.transform(grams(h, g), lambda x, i: F.struct(x.alias("fp"), i.alias("pos"), F.lit(n).alias("n")))).otherwise(empty)
    places = found.select("id", "text_hash", F.explode(let(hashed(F.col("words")), lambda h: F.concat(tagged(h, k, window), *[tagged(h, n, n) for n in short]))).alias("p")).select("id", "text_hash", "p.*")
    hits = places.join(small(prints), ["fp", "n"], "left_semi").groupBy("id", "text_hash").agg(F.collect_set(F.struct("pos", "n")).alias("hits"))
    # extend every hit to the windows that hold it
    hits = hits.withColumnsRenamed({"id": "cid", "text_hash": "chash"})
    last = F.size("words") - window
    around = F.array_distinct(F.flatten(F.transform(F.filter("hits", lambda p: p["n"] == window), lambda p: F.sequence(F.greatest(p["pos"] - (window - k), F.lit(0)), F.least(p["pos"], last)))))
    exact = [windows_at(F.col("words"), F.transform(F.filter("hits", of_length(n)), lambda p: p["pos"]), n) for n in short]
    spans = found.join(hits, same).select("id", "text_hash", F.explode(F.concat(windows_at(F.col("words"), around, window), *exact)).alias("w")).select("id", "text_hash", "w.*")
    spans = work.save(spans.join(small(windows.select("window").distinct(), windows), "window", "left_semi"), "spans")
    sorted_spans = F.array_sort(F.collect_set(F.struct("start", "n")))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("words"))
    covered = lambda acc, x: F.struct(F.greatest(acc["end"], x["start"] + x["n"]).alias("end"), (acc["words"] + F.greatest(x["start"] + x["n"] - F.greatest(acc["end"], x["start"]), F.lit(0))).alias("words"))
    n_hit = spans.groupBy("id", "text_hash").agg(sorted_spans.alias("s")).select("id", "text_hash", F.aggregate("s", start, covered, lambda acc: acc["words"].cast("long")).alias("n_hit"))
    named = spans.select("id", "text_hash", "window").distinct().join(small(windows), "window").groupBy("id", "text_hash").agg(F.array_sort(F.collect_set("item")).alias("items"))
    leaks = n_hit.join(named.withColumnsRenamed({"id": "nid", "text_hash": "nhash"}), F.col("id").eqNullSafe(F.col("nid")) & (F.col("text_hash") == F.col("nhash"))).select(F.col("id").alias("cid"), F.col("text_hash").alias("chash"), "n_hit", "items")
    leaks = work.save(leaks, "leaks")
    joined = keys.join(small(leaks), same, "left")
    return joined.select("id", "text_hash", "n_rows", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("row", F.explode(F.sequence(F.lit(1), F.col("n_rows"))))
    return leaks.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


SQL = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM benchmark),
iw AS (SELECT DISTINCT item, n, array_to_string(list_slice(words, s, s + n - 1), ' ') AS win FROM (SELECT item, words, least(10, len(words)) AS n, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS s FROM i WHERE len(words) > 0)),
lengths AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, n, s, array_to_string(list_slice(words, s, s + n - 1), ' ') AS win FROM (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS s FROM w, lengths)),
hit AS (SELECT dw.r, dw.n, dw.s, iw.item FROM dw JOIN iw USING (n, win)),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, n, s FROM hit)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
