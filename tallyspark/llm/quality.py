"""Quality classifier as a sparse rule ensemble.

Statistics of the whole text are Spark columns. Small boosted trees are grown on a bounded sample of labelled
rows; every path from a root is a conjunctive rule over statistics. A lasso logistic fit keeps few of the
rules, and those are compiled into one Spark column expression, so that scoring the corpus is a projection.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._work import table

#: At most so many labelled rows are fitted; the bound of what comes to the driver.
SAMPLE_ROWS = 20_000
TREES, DEPTH, THRESHOLDS = 24, 3, 24
LASSO, FIT_STEPS = 0.002, 800
KEEP_AT = 0.3


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text by name; defined for null and empty texts (as those of an empty text)."""
    t = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "")
    without = lambda pattern: F.length(F.regexp_replace(t, pattern, ""))
    return {"chars": F.length(t), "words": words, "upper": without("[^A-ZÀ-ÖØ-Þ]+"), "letters": without(r"[^\p{L}]+"), "digits": without("[^0-9]+"), "symbols": without(r"[\p{L}\p{N}\s.,;:'\"()?-]+"), "lines": without("[^\n]+")}


def features(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """docs[keep] with one double column for each name in FEATURES."""
    raw = docs.select(*keep, *[v.alias(f"__{k}") for k, v in statistics(F.col(text_col)).items()])
    same = F.size(F.filter("__words", lambda w, i: (i > 0) & (w == F.get("__words", i - 1))))
    raw = raw.select(*keep, *[F.col(f"__{k}").cast("double").alias(k) for k in ("chars", "upper", "letters", "digits", "symbols", "lines")], F.size("__words").cast("double").alias("words"), F.size(F.array_distinct("__words")).cast("double").alias("distinct"), same.cast("double").alias("same"))
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1.0))
    made = {
        "log_words": F.log1p("words"),
        "word_length": per("chars", "words"),
        "upper_share": per("upper", "letters"),
        "letter_share": per("letters", "chars"),
        "digit_share": per("digits", "chars"),
        "symbol_rate": per("symbols", "words"),
        "line_rate": per("lines", "words"),
        "distinct_share": per("distinct", "words"),
        "distinct_power": F.log1p("distinct") / F.greatest(F.log1p("words"), F.lit(1.0)),
        "repeat_share": per("same", "words"),
        "repeats": F.log1p("same"),
    }
    return raw.select(*keep, *[v.alias(k) for k, v in made.items()])


FEATURES = ("log_words", "word_length", "upper_share", "letter_share", "digit_share", "symbol_rate", "line_rate", "distinct_share", "distinct_power", "repeat_share", "repeats")

Rule = tuple[tuple[int, str, float], ...]


def grow(x: np.ndarray, gradient: np.ndarray, cuts: list[np.ndarray], depth: int, least: int = 12) -> list[tuple[Rule, np.ndarray]]:
    """The nodes below the root of a least-squares tree, each as (rule, rows)."""
    nodes, todo = [], [((), np.arange(len(x)))]
    while todo:
        rule, rows = todo.pop()
        if len(rule) == depth or len(rows) < 2 * least:
            continue
        best = (1e-9, None)
        g, total = gradient[rows], gradient[rows].sum()
        for j, at in enumerate(cuts):
            left = x[rows, j][:, None] <= at[None, :]
            n = left.sum(0)
            s = g @ left
            ok = (n >= least) & (len(rows) - n >= least)
            gain = np.where(ok, s**2 / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(len(rows) - n, 1) - total**2 / len(rows), 0)
            if len(at) and gain.max() > best[0]:
                best = (gain.max(), (j, at[gain.argmax()]))
        if best[1] is None:
            continue
        j, at = best[1]
        left = x[rows, j] <= at
        for op, part in (("<=", rows[left]), (">", rows[~left])):
            child = (*rule, (j, op, float(at)))
            nodes.append((child, part))
            todo.append((child, part))
    return nodes


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for j, op, at in rule:
        out &= x[:, j] <= at if op == "<=" else x[:, j] > at
    return out


def fit_rules(x: np.ndarray, y: np.ndarray, *, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, steps: int = FIT_STEPS) -> tuple[float, list[tuple[float, Rule]]]:
    """Intercept and weighted rules. One class or no rows give the intercept alone."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    prior = float(np.log(rate / (1 - rate)))
    if len(y) == 0 or y.min() == y.max():
        return prior, []
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, THRESHOLDS + 2)[1:-1])) for j in range(x.shape[1])]
    score, found, rng = np.full(len(y), prior), {}, np.random.default_rng(5)
    for _ in range(trees):
        rows = rng.choice(len(y), size=max(len(y) // 2, min(len(y), 50)), replace=False)
        p = 1 / (1 + np.exp(-score))
        nodes = grow(x[rows], (y - p)[rows], cuts, depth)
        inner = {r[:-1] for r, _ in nodes}
        for rule, part in nodes:
            found.setdefault(tuple(sorted(rule)), None)
            if rule not in inner:
                q = p[rows][part]
                score[holds(rule, x)] += 0.3 * ((y[rows][part] - q).sum() / max((q * (1 - q)).sum(), 1e-3))
    rules = list(found)
    m = np.stack([holds(r, x) for r in rules], axis=1).astype(np.float64)
    spread = np.maximum(m.std(0), 0.02)
    m = m / spread  # penalise rare and common rules alike
    w, b, step = np.zeros(m.shape[1]), prior, 4.0 / (np.linalg.norm(m, 2) ** 2 / len(y) + 1)
    v, vb, t = w.copy(), b, 1.0
    for _ in range(steps):  # FISTA
        p = 1 / (1 + np.exp(-(m @ v + vb)))
        w2 = v - step * (m.T @ (p - y)) / len(y)
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * lasso, 0)
        b2 = vb - step * (p - y).mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return float(b), [(float(w[i] / spread[i]), rules[i]) for i in np.flatnonzero(np.abs(w) > 1e-6)]


def compile_rules(intercept: float, rules: list[tuple[float, Rule]]) -> Column:
    """The score as a column over FEATURES."""
    total = F.lit(intercept)
    for weight, rule in rules:
        test = F.lit(True)
        for j, op, at in rule:
            test = test & (F.col(FEATURES[j]) <= at if op == "<=" else F.col(FEATURES[j]) > at)
        total = total + F.when(test, F.lit(weight)).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def id_hash(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> tuple[float, list[tuple[float, Rule]]]:
    """Fit on the labelled rows of docs, or on sample_rows of them by hash of the id where there are more.

    Of labels that repeat an id the largest counts, of texts the least. Null labels are left out.
    """
    marks = labels.where(F.col(label).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label).cast("double").alias("__y"))
    few = marks.orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)
    chosen = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(few), "__id").groupBy("__id", "__y").agg(F.min("__text").alias("__text"))
    rows = features(chosen, "__text", ["__y"]).select("__y", *FEATURES).collect()
    data = np.array(sorted(tuple(r) for r in rows), dtype=np.float64).reshape(-1, len(FEATURES) + 1)
    return fit_rules(data[:, 1:], data[:, 0])


def score_quality(docs: DataFrame, model: tuple[float, list[tuple[float, Rule]]], *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs[keep] with score (0 to 1, higher: better) and predicted. Null and empty texts are scored as empty."""
    keep = keep or [c for c in docs.columns if c not in ("score", "predicted")]
    held = docs.withColumn("__keep", F.struct(*[F.col(f"`{c}`") for c in keep]))
    scored = features(held, text_col, ["__keep"]).select("__keep", compile_rules(*model).alias("score"))
    return scored.select(*[F.col(f"__keep.`{c}`").alias(c) for c in keep], "score", (F.col("score") >= KEEP_AT).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = id_hash("doc_id") % 5 == 0
    model = fit(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out))
    return score_quality(docs.withColumn("held_out", held_out), model, keep=["doc_id", "held_out"])
