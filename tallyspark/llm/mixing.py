"""Mixing sources to target weights by entropy balancing.

Each source has a target in words. Among all document rates in [0, 2] that meet the target, those nearest
to 1 in relative entropy are min(2, exp(lambda * size / mean size)), one multiplier for each source. The
multipliers solve a convex dual; its gradient and Hessian are sums over (source, size, documents), so every
Newton step is one small aggregation over that histogram, kept inside a bracket. Rates become whole copies
by cumulative rounding from long to short documents, then single copies move to absorb what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._work import Workspace, count_words, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2
STEPS, REPAIRS = 40, 3
#: Documents of one source and size are ranked in groups of about this many.
GROUP = 256


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sk, source_size -> with target. Water-filling in closed form over one row per source: sources in order
    of most * size / weight are capped as long as the level of the others lies above them."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1)
    w = sizes.withColumn("w", cycle).withColumn("cap", most * F.col("source_size").cast("double"))
    everything = Window.partitionBy(F.lit(0))
    up = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), "w", "sk").rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumns({"cap_before": F.coalesce(F.sum("cap").over(up), F.lit(0.0)), "w_left": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(up), F.lit(0.0)), "all": share * F.sum("source_size").over(everything)})
    w = w.withColumn("level", (F.col("all") - F.col("cap_before")) / F.col("w_left"))
    first = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(everything)
    return w.withColumn("target", F.least(F.col("cap"), F.coalesce(first["level"], F.lit(float("inf"))) * F.col("w"))).select("sk", "source_size", "n", "target")


def exact_sum(value: Column) -> Column:
    """A sum of doubles that does not depend on the order of rows, so that reruns agree."""
    return F.sum(value.cast("decimal(38,6)")).cast("double")


def balance(hist: DataFrame, targets: DataFrame, work: Workspace) -> DataFrame:
    """sk, target, source_size, mean, lam: the dual solution by safeguarded Newton steps."""
    inf = float("inf")
    state = work.save(targets.where("source_size > 0").select("sk", "target", "source_size", (F.col("source_size") / F.col("n")).alias("mean"), F.lit(0.0).alias("lam"), F.lit(-inf).alias("lo"), F.lit(inf).alias("hi"), F.lit(inf).alias("error")), "dual0")
    for step in range(1, STEPS + 1):
        tilt = F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(700.0)))
        words = F.col("n") * F.col("size")
        sums = hist.join(state, "sk").groupBy("sk", "target", "source_size", "mean", "lam", "lo", "hi").agg(
            exact_sum(words * F.least(F.lit(float(MOST)), tilt)).alias("got"),
            exact_sum(F.when(tilt < MOST, words * tilt * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"),
        )
        gap = F.col("got") - F.col("target")
        lo, hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap >= 0, F.col("lam")).otherwise(F.col("hi"))
        sums = sums.withColumns({"error": F.abs(gap) / F.greatest(F.lit(1.0), F.col("target")), "lo": lo, "hi": hi, "newton": F.col("lam") - gap / F.nullif(F.col("slope"), F.lit(0.0))})
        halved = F.when(F.col("lo") == -inf, F.col("hi") * 2 - 1).when(F.col("hi") == inf, F.col("lo") * 2 + 1).otherwise((F.col("lo") + F.col("hi")) / 2)
        moved = F.when(F.col("error") < 1e-9, F.col("lam")).when((F.col("newton") > F.col("lo")) & (F.col("newton") < F.col("hi")), F.col("newton")).otherwise(halved)
        full = F.col("target") >= MOST * F.col("source_size") * (1 - 1e-12)  # every document twice: no finite multiplier is needed
        sums = sums.withColumns({"lam": F.when(full, F.lit(inf)).otherwise(moved), "error": F.when(full, F.lit(0.0)).otherwise(F.col("error"))})
        state = work.save(sums.select(*state.columns), f"dual{step}")
        worst = state.agg(F.max("error")).first()[0]
        work.drop(f"dual{step - 1}")
        if worst is None or worst < 1e-6:
            return state
    raise RuntimeError(f"the multipliers did not settle in {STEPS} steps; relative error {worst}")


def copies_by_size(hist: DataFrame, dual: DataFrame, work: Workspace) -> DataFrame:
    """sk, size, n, target, total: whole copies of all documents of one source and size."""
    tilt = F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(700.0)))
    rate = F.when(F.col("lam") == float("inf"), F.lit(float(MOST))).otherwise(F.least(F.lit(float(MOST)), tilt))
    upto = F.sum(F.col("rate") * F.col("n")).over(Window.partitionBy("sk").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0))
    rated = hist.join(dual.select("sk", "target", "mean", "lam"), "sk").withColumn("rate", rate).withColumn("upto", upto)
    total = F.floor(F.col("upto") + 0.5) - F.floor(F.col("upto") - F.col("rate") * F.col("n") + 0.5)
    plan = work.save(rated.select("sk", "size", "n", "target", F.least(F.greatest(total, F.lit(0)), MOST * F.col("n")).cast("long").alias("total")), "copies0")
    for step in range(1, REPAIRS + 1):
        short = plan.groupBy("sk").agg((F.first("target") - F.sum(F.col("total") * F.col("size"))).alias("short"))
        with_gap = plan.join(short, "sk")
        fits = F.when(F.col("short") > 0, F.col("total") < MOST * F.col("n")).otherwise(F.col("total") > 0)
        after = F.abs(F.abs(F.col("short")) - F.col("size"))
        move = with_gap.where(fits & (after < F.abs("short"))).groupBy("sk").agg(F.min(F.struct(after.alias("after"), F.col("size").alias("at"), F.signum("short").cast("long").alias("by"))).alias("m")).select("sk", F.col("m.at").alias("size"), F.col("m.by").alias("by"))
        plan = work.save(plan.join(move, ["sk", "size"], "left").select("sk", "size", "n", "target", (F.col("total") + F.coalesce("by", F.lit(0))).alias("total")), f"copies{step}")
    return plan


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each key (id, text_hash) of docs: id, text_hash, n_rows, size, source_size, target, copies.

    Rows that repeat id, text and source are one document here: all get the same copies. Null source is a
    source of its own, null text has size 0; documents of size 0 are never taken. No document gets over 2 copies.
    """
    spark = docs.sparkSession
    work = Workspace(spark)
    source = F.col(source_col).cast("string")
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), source.alias("source"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("sk"), count_words(F.col(text_col)).alias("words"))
    keyed = keyed.groupBy("id", "text_hash", "source", "sk", "words").agg(F.count("*").alias("n_rows")).withColumn("size", F.col("words") * F.col("n_rows"))
    keyed = work.save(keyed, "keyed")
    hist = work.save(keyed.where("size > 0").groupBy("sk", "size").agg(F.count("*").alias("n")), "hist")
    totals = keyed.groupBy("sk").agg(F.first("source", ignorenulls=True).alias("source"), F.sum("size").alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("n"))
    targets = work.save(source_targets(totals), "targets")
    plan = copies_by_size(hist, balance(hist, targets, work), work)

    rows = keyed.join(plan.select("sk", "size", "n", "total"), ["sk", "size"], "left").join(targets.select("sk", "source_size", "target"), "sk")
    rows = rows.withColumns({"h": F.xxhash64("id", "text_hash", F.lit(7)), "base": F.floor(F.col("total") / F.col("n")), "extra": F.col("total") % F.col("n")})
    rows = rows.withColumn("salt", F.pmod("h", F.greatest(F.ceil(F.col("n") / GROUP), F.lit(1))))
    group = ["sk", "size", "salt"]
    upto = F.sum("c").over(Window.partitionBy("sk", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0))
    share = lambda n: F.floor(F.col("extra") * n / F.col("n"))  # noqa: E731  the extra copies of a size, dealt over its groups without loss
    quota = rows.where("extra > 0").groupBy(*group, "n", "extra").agg(F.count("*").alias("c")).withColumn("upto", upto)
    quota = quota.select(*group, (share(F.col("upto")) - share(F.col("upto") - F.col("c"))).alias("quota"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("h", "id", "text_hash"))
    rows = rows.withColumn("rank", rank).join(quota, group, "left")
    copies = F.coalesce(F.col("base") + (F.col("rank") <= F.coalesce("quota", F.lit(0))).cast("long"), F.lit(0))
    return rows.select("id", "text_hash", "source", "n_rows", F.col("words").alias("size"), "source_size", "target", copies.alias("copies"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents")).withColumn("row", F.explode(F.sequence(F.lit(1), F.col("n_rows"))))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
