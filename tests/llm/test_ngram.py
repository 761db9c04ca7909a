"""The n-gram model against a brute-force one, and what its probabilities have to fulfil."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from tallyspark.llm import ngram
from tallyspark.llm._work import Workspace


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower()), ""]


class Brute:
    """Interpolated absolute discounting over plain dictionaries."""

    def __init__(self, texts):
        runs = [tokens(t) for t in texts]
        self.counts = [Counter(tuple(r[i : i + k]) for r in runs for i in range(len(r) - k + 1)) for k in (1, 2, 3)]
        self.fans = [Counter(g[:-1] for g in c) for c in self.counts]
        once, twice = (sum(c == k for c in self.counts[0].values()) for k in (1, 2))
        self.discount = min(max(once / (once + 2 * twice) if once else 0.5, 0.1), 0.9)
        self.n, self.v = sum(self.counts[0].values()), len(self.counts[0])

    def p(self, gram):
        if len(gram) == 1:
            c = self.counts[0][gram]
            return (c - self.discount) / self.n if c else self.discount * self.v / self.n / ngram.unseen_words(self.v, self.discount)
        shorter, context = self.p(gram[1:]), self.counts[len(gram) - 2][gram[:-1]]
        if not context:
            return shorter
        c = self.counts[len(gram) - 1][gram]
        return min(max(c - ngram.DISCOUNT, 0) / context + ngram.DISCOUNT * self.fans[len(gram) - 1][gram[:-1]] / context * shorter, 1)

    def score(self, text):
        run = tokens(text)
        return sum(math.log10(self.p(tuple(run[max(i - 2, 0) : i + 1]))) for i in range(len(run)))


def scores(spark, texts, model):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["score"] for r in ngram.score_texts(frame, model).collect()}
    return [got[str(i)] for i in range(len(texts))]


def trained(spark, texts):
    return ngram.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), Workspace(spark))


def test_scores_equal_a_brute_force_model(spark):
    texts = ["a b c a b d", "a b e f g", "h i", "", None, "g A\tb", "a b c a b c x"]
    ask = [*texts, "c d", "unknown b e", "f g h", "a b zz", "zz a b c"]
    brute = Brute(texts)
    assert min(brute.counts[1].values()) == min(brute.counts[2].values()) == 1  # sequences seen once count
    assert scores(spark, ask, trained(spark, texts)) == pytest.approx([brute.score(t) for t in ask], abs=0.02)


def test_many_shards_runs_and_long_texts(spark, monkeypatch):
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, rng.integers(0, 400)) % 500) for _ in range(60)] + ["the cat " * 3000, None, ""]
    monkeypatch.setattr(ngram, "SHARD_BYTES", 4000)
    monkeypatch.setattr(ngram, "COUNT_TOKENS", 500)  # much shorter than the longest text
    monkeypatch.setattr(ngram, "SCORE_TOKENS", 700)
    model, brute = trained(spark, texts), Brute(texts)
    assert model[3] > 2 and len(model[1]) > 4
    assert model[4] == {"words": brute.v, "tokens": brute.n, "once": sum(c == 1 for c in brute.counts[0].values()), "twice": sum(c == 2 for c in brute.counts[0].values())}
    ask = [*texts[:20], "the cat the dog w1 w2", "w1 w1 w1"]
    want = [brute.score(t) for t in ask]
    got = scores(spark, ask, model)
    assert all(abs(g - w) <= 0.02 + 0.003 * len(tokens(t)) for g, w, t in zip(got, want, ask, strict=True))


def test_probabilities_sum_to_one_and_invented_words_score_below_rare_ones(spark):
    texts = ["a b c a b d", "a b e f g", "b a d", "rare"]
    model, brute = trained(spark, texts), Brute(texts)
    words = [w for (w,) in brute.counts[0]]
    unseen = ngram.unseen_words(brute.v, brute.discount)
    trie = ngram.Model(*model)
    hashed = lambda run: np.array([ngram.xxhash.xxh3_64_intdigest(w.encode()) for w in run], dtype=np.uint64)
    for context in (["a", "b"], ["b"], ["zz"], []):
        base = trie.score([hashed(context)])["score"][0] if context else 0.0
        p = [10 ** (trie.score([hashed([*context, w])])["score"][0] - base) for w in words]
        new = 10 ** (trie.score([hashed([*context, "neverseen"])])["score"][0] - base)
        assert sum(p) + unseen * new == pytest.approx(1, abs=0.03)
    rare, invented = trie.score([hashed(["rare"]), hashed(["qqqq"])])["score"]
    assert invented < rare


def test_empty_training_table(spark):
    model = trained(spark, [])
    assert scores(spark, ["a b", None], model) == [0.0, 0.0]
