"""Toxicity classifier with counterfactual regularisation.

A document is the set of its words and of their first letters. A bounded sample of labelled rows gives the
terms that tell most about the label and a lasso logistic fit over them. In labelled sentences that name a
group, the group's term is swapped for others of its kind; the fit pays for every change of score that a swap
makes, so the mention of a group as such moves no score.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._work import table
from .quality import id_hash

#: At most so many labelled rows are fitted, over at most so many terms (below 65,536): the bounds of what comes to
#: the driver. Terms of fewer documents of the sample cannot be told from chance.
SAMPLE_ROWS, TERMS = 20_000, 4_096
LEAST_DOCS = 4
LASSO, SWAP_PENALTY, STEPS = 0.0004, 4.0, 600
REJECT_AT = 0.7
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")
STEMS = (4, 5, 6)
#: Groups of terms that are swapped for each other.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("disabled", "deaf", "blind", "elderly", "young"),
)


def terms_of(word: str) -> tuple[str, ...]:
    return (word, *[word[:n] + "*" for n in STEMS if len(word) >= n])


def terms(text: str | None) -> set[str]:
    return {t for w in set(WORD.findall((text or "").lower())) for t in terms_of(w)}


def swaps(text: str | None, groups=IDENTITY_GROUPS) -> list[tuple[set[str], set[str]]]:
    """(terms gained, terms lost) of every swap in every sentence that holds a group's term."""
    kin = {w: g for g in groups for w in g}
    out = []
    for sentence in SENTENCE.split((text or "").lower()):
        found = WORD.findall(sentence)
        for old in {w for w in found if w in kin}:
            before = {t for w in found for t in terms_of(w)}
            for new in kin[old]:
                if new != old:
                    after = {t for w in found for t in terms_of(new if w == old else w)}
                    out.append((after - before, before - after))
    return out


def choose_terms(sample: DataFrame, n_terms: int, least_docs: int) -> list[str]:
    """Those that tell most about the label (G squared) over the sample; counts are added up by Spark."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, hit = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch["text"], batch["y"], strict=True):
                own = terms(text)
                seen.update(own)
                if y:
                    hit.update(own)
        yield pd.DataFrame({"term": list(seen), "n": list(seen.values()), "k": [hit[t] for t in seen]})

    total = sample.agg(F.count("*").alias("n"), F.sum("y").alias("k")).first()
    if not total["n"] or total["k"] in (0, total["n"]):
        return []
    rate = total["k"] / total["n"]
    n, k = F.col("n"), F.col("k")
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    counts = sample.select("text", "y").mapInPandas(count, "term string, n long, k long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).where(n >= least_docs)
    return [r["term"] for r in counts.orderBy((part(k, n * rate) + part(n - k, n * (1 - rate))).desc(), "term").limit(n_terms).collect()]


class Sets:
    """Rows of sorted term numbers as one flat array, multiplied in runs of bounded size; no dense matrix is made."""

    RUN = 500_000

    def __init__(self, flat: np.ndarray, lengths: np.ndarray, n_terms: int):
        self.flat, self.ends, self.n_terms = flat, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), n_terms
        self.cuts = [0]
        while self.cuts[-1] < len(lengths):
            at = self.cuts[-1]
            self.cuts.append(max(at + 1, int(np.searchsorted(self.ends, self.ends[at] + self.RUN, "right")) - 1))

    def runs(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        for lo, hi in itertools.pairwise(self.cuts):
            flat, ends = self.flat[self.ends[lo] : self.ends[hi]], self.ends[lo : hi + 1] - self.ends[lo]
            yield slice(lo, hi), flat, np.repeat(np.arange(hi - lo), np.diff(ends))

    def times(self, u: np.ndarray) -> np.ndarray:
        """For each row the sum of u over its terms."""
        out = np.zeros(len(self.ends) - 1)
        for rows, flat, row in self.runs():
            out[rows] = np.bincount(row, u[flat], rows.stop - rows.start)
        return out

    def back(self, r: np.ndarray) -> np.ndarray:
        """For each term the sum of r over the rows that hold it."""
        out = np.zeros(self.n_terms)
        for rows, flat, row in self.runs():
            out += np.bincount(flat, r[rows][row], self.n_terms)
        return out


def fit_lasso(sets: Sets, y: np.ndarray, gain: Sets, loss: Sets, *, lasso: float = LASSO, swap_penalty: float = SWAP_PENALTY, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Sparse logistic regression over sets of terms; gain and loss are the two sides of changes that should not move the score."""
    n, m, n_terms = len(y), len(gain.ends) - 1, sets.n_terms
    rate = (y.sum() + 0.5) / (n + 1)
    w, b = np.zeros(n_terms), float(np.log(rate / (1 - rate)))
    if not n or not n_terms:
        return b, w
    scale = np.sqrt(sets.back(np.ones(n)) / max(n, 1)) + 0.02  # penalise rare and common terms alike

    def swapped(u):
        d = gain.times(u) - loss.times(u)
        return 2 * swap_penalty / m * (gain.back(d) - loss.back(d))

    def gradient(v, vb):
        u = v / scale
        p = 1 / (1 + np.exp(-np.clip(sets.times(u) + vb, -30, 30)))
        g = sets.back(p - y) / n + (swapped(u) if m else 0)
        return g / scale, (p - y).mean()

    q = np.random.default_rng(3).normal(size=n_terms)
    for _ in range(12):  # the largest curvature, by power iteration
        u = q / np.linalg.norm(q) / scale
        q = (0.25 * sets.back(sets.times(u)) / n + (swapped(u) if m else 0)) / scale
    step = 0.8 / (np.linalg.norm(q) + 0.25)
    v, vb, t = w.copy(), b, 1.0
    for _ in range(steps):  # FISTA
        g, gb = gradient(v, vb)
        w2 = v - step * g
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * lasso, 0)
        b2 = vb - step * gb
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, vb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return float(b), w / scale


class Model(NamedTuple):
    intercept: float
    weights: dict[str, float]
    n_rows: int = 0
    n_swaps: int = 0


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS, n_terms: int = TERMS, least_docs: int = LEAST_DOCS, swap_penalty: float = SWAP_PENALTY, groups=IDENTITY_GROUPS) -> Model:
    """The model of sample_rows of the labelled rows at most (by hash of the id), over n_terms terms at most, each of
    least_docs documents of the sample at least. n_swaps tells how many swaps of identity terms it was held to.

    Of labels that repeat an id the largest counts, of texts the least. Null labels and ids without a document are left out; one
    class alone gives the intercept.
    """
    marks = labels.where(F.col(label).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("y"))
    few = marks.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(few), "id").groupBy("id", "y").agg(F.min("text").alias("text")).select("text", "y")
    vocabulary = choose_terms(sample, n_terms, least_docs)
    place = {t: i for i, t in enumerate(vocabulary)}
    pack = lambda parts: np.array([x for p in parts for x in p], dtype="<u2").tobytes()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = lambda found: sorted(place[t] for t in found if t in place)
        for batch in batches:
            rows = []
            for y, text in zip(batch["y"], batch["text"], strict=True):
                changed = [x for a, b in swaps(text, groups) if any(x := (ids(a), ids(b)))]
                sides = [[c[k] for c in changed] for k in (0, 1)]
                rows.append((y, pack([ids(terms(text))]), *[f([len(p) for p in side] if f is counts else side) for side in sides for f in (pack, counts)]))
            yield pd.DataFrame(rows, columns=["y", "at", "gain", "n_gain", "loss", "n_loss"])

    counts = lambda lengths: np.array(lengths, dtype="<u2").tobytes()
    # at most sample_rows rows of two bytes a term; an order of their own makes reruns agree
    rows = sorted(sample.mapInPandas(encode, "y int, at binary, gain binary, n_gain binary, loss binary, n_loss binary").toLocalIterator(), key=lambda r: (bytes(r["at"]), r["y"]))
    flat = lambda name: np.frombuffer(b"".join(bytes(r[name]) for r in rows), dtype="<u2")
    sets = Sets(flat("at"), np.array([len(r["at"]) // 2 for r in rows], dtype=np.int64), len(vocabulary))
    gain, loss = (Sets(flat(k), flat(f"n_{k}").astype(np.int64), len(vocabulary)) for k in ("gain", "loss"))
    y = np.array([r["y"] for r in rows], dtype=np.float64)
    del rows
    intercept, weights = fit_lasso(sets, y, gain, loss, swap_penalty=swap_penalty)
    return Model(intercept, {t: float(w) for t, w in zip(vocabulary, weights, strict=True) if abs(w) > 1e-9}, len(y), len(gain.ends) - 1)


def score_of(text: Column, model: Model) -> Column:
    """The score of a text (0 to 1, higher: more toxic). Null and empty texts get that of a text without terms."""
    intercept, weights = model.intercept, model.weights

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            out = []
            for text in batch:
                found: set[str] = set()
                for word in set(WORD.findall(text.lower())) if text else ():
                    own = cache.get(word)
                    if own is None:
                        if len(cache) > 300_000:
                            cache.clear()
                        own = cache[word] = tuple(t for t in terms_of(word) if t in weights)
                    if own:
                        found.update(own)
                total = intercept + math.fsum(weights[t] for t in found)
                out.append(1 / (1 + math.exp(-max(min(total, 500.0), -500.0))))
            yield pd.Series(out, dtype="float64")

    return F.pandas_udf(score, "double")(text)


def score_toxicity(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """All rows and columns of docs with score and predicted; columns of these names are replaced. Repeated rows
    are scored alike, texts of any length whole. An empty table gives an empty result."""
    scored = docs.withColumn("score", score_of(F.col(f"`{text_col}`"), model))
    return scored.withColumn("predicted", (F.col("score") >= REJECT_AT).cast("int"))


def train_rows(id_col: str = "doc_id"):
    return id_hash(id_col) % 3 != 1


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs.where(train_rows()), table(spark, sf_dir, "labels").where(train_rows()))
    return score_toxicity(docs, model).select("doc_id", (~train_rows()).alias("held_out"), "score", "predicted")
