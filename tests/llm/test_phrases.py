import random
from collections import Counter

import re

from tallyspark.llm import phrases


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, least, longest, top):
    """rows (lang, text) -> the same rows as mine_phrases, from dictionaries of all phrases."""
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text or "")):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items()):
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, n + 1, p.decode(), -a, l, r, totals[lang], -s) for n, (s, a, p, l, r) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(t, l, k % 3, "x") for k, (l, t) in enumerate(rows)], "text string, lang string, doc_id int, phrase string")
    return sorted(map(tuple, phrases.mine_phrases(df.repartition(3), **options).collect()))


def texts(seed, n):
    """Words of a small vocabulary with fixed phrases among them, and all that cuts."""
    r = random.Random(seed)
    fixed = ["New york", "one two three", "one two three four five", "a a a", "é ü x", "　wide word", "ab ab"]
    out = []
    for _ in range(n):
        parts = [r.choice(fixed) if r.random() < 0.4 else "w%d" % r.randrange(12) for _ in range(r.randrange(60))]
        out.append((r.choice(["en", "de", None, "und"]), "".join(p + r.choice([" ", "  ", "\t", " ", ". ", ",", "\n", "\r\n", "!?"]) for p in parts)))
    return out


def test_equals_brute_force(spark):
    rows = [*texts(1, 120), ("en", None), (None, None), ("fr", ""), ("fr", " .,\n"), ("en", "lonely")]
    rows += [("en", "UP up Up")] * 7  # repeated rows
    for least, top, size in ((5, 2000, 1 << 24), (9, 6, 700)):  # small units: names meet from many of them
        assert mined(spark, rows, least=least, top=top, unit_bytes=size) == brute(rows, least, 4, top)


def test_overlaps_long_texts_and_runs_of_one_word(spark):
    rows = [("en", "a " * 3000), ("de", "b b b. " * 400), ("de", "x y " * 20_000)]
    assert mined(spark, rows) == brute(rows, 30, 4, 2000)


def test_shorter_phrases_only(spark):
    rows = texts(2, 60)
    assert mined(spark, rows, least=4, longest=2) == brute(rows, 4, 2, 2000)
    assert mined(spark, rows, least=4, longest=3) == brute(rows, 4, 3, 2000)


def test_empty(spark):
    assert mined(spark, [], least=1) == []
    assert mined(spark, [("en", ""), (None, None)], least=1) == []
