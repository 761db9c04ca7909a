"""The numbered operators against brute force, exact round trips or held-out accuracy, and their edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import chat, decontaminate, embeddings, lines, mixing, neardup, ngram, quality, sharding, toxicity
from tallyspark.llm._work import Workspace, count_words
from tallyspark.llm.eliasfano import EliasFano
from tallyspark.llm.graph import connected_components
from tallyspark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, shard string"
VOCABULARY = [f"w{i}" for i in range(400)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, None, "x") for i, t, s in rows], DOCS)


def sample(n=60, seed=1, words=40):
    rng = np.random.default_rng(seed)
    texts = [" ".join(rng.choice(VOCABULARY, words)) for _ in range(n)]
    for i in range(0, n - 1, 5):  # near copies
        own = texts[i].split()
        own[3] = "changed"
        texts[i + 1] = " ".join(own)
    texts[n - 1] = texts[0]
    return texts


ODD = [(None, "a text without id", "a"), (500, None, None), (501, "", "a"), (502, " \n\t", "b"), (503, "x", "a"), (503, "x", "a"), (504, "longer " * 30_000, "b")]


def rows_of(texts):
    return [(i, t, "abc"[i % 3]) for i, t in enumerate(texts)]


def test_elias_fano():
    values = np.unique(np.random.default_rng(0).integers(0, 1 << 45, 5000)).astype(np.uint64)
    ef = EliasFano.build(values)
    assert (ef.get(np.arange(len(values))) == values).all()
    ask = np.concatenate([values[::7], values[::5] + np.uint64(1), np.array([0, 1 << 50], dtype=np.uint64)])
    at, equal = ef.successor(ask)
    assert (at == np.searchsorted(values, ask)).all()
    assert (equal == np.isin(ask, values)).all()


def test_lm_scores(spark):
    rows = rows_of(sample()) + ODD
    train = [t or "" for i, t, _ in rows if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2]
    tokens = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), b""]
    counts = Counter(w for t in train for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    df = docs(spark, rows)
    model = ngram.train(df.where(quality.id_hash("doc_id") % 7 != 2), Workspace(spark))
    got = {r["id"]: r for r in ngram.score_texts(df, model).collect()}
    for i, t, _ in rows:
        if i is None:
            continue
        own, r = tokens(t), got[str(i)]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] <= 0
    scored = [(r["score"], r["base_score"]) for r in QUERIES["op1_lm_scoring"](spark, SF).collect() if r["held_out"]]
    assert sum(a for a, _ in scored) > sum(b for _, b in scored)
    none = ngram.train(df.where("false"), Workspace(spark))
    assert ngram.score_texts(df, none).count() == len(rows)


def test_chat_round_trip(spark):
    tricky = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "a<|", "|>", "", None, "é\n漢字 🙂", " lead", "trail "]
    rows = [(c, t, "assistant" if t % 2 else "user", x) for c, shift in ((1, 0), (2, 3)) for t, x in enumerate(tricky[shift:] + tricky[:shift])] + [(3, 0, None, None), (None, 0, "assistant", "x"), (4, 0, "user", "long " * 20_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.format_conversations(frame).collect():
        turns = [(role or "", text or "") for c, _, role, text in rows if c == r["conv_id"]]
        assert chat.parse(r["formatted"]) == turns
        mask = np.array(r["loss_mask"], dtype=bool)
        loss = "".join(chat.unescape(r["formatted"][a:b]) for a, b in chat.covered(np.array(r["token_starts"]), np.array(r["token_ends"]), mask))
        assert loss == "".join(x for role, x in turns if role == "assistant")
    assert chat.format_conversations(frame.where("false")).isEmpty()


def test_chat_query_digests(spark):
    rows = {r["conv_id"]: r for r in QUERIES["op2_chat"](spark, SF).collect()}
    own = "<|im_end|><|im_start|>assistant ok"
    assert rows[-1]["turns_sha256"] == hashlib.sha256(f"user\n{own}\nassistant\n{own}\n".encode()).hexdigest()
    assert (rows[-1]["loss_chars"], rows[-1]["loss_sha256"]) == (len(own), hashlib.sha256(own.encode()).hexdigest())


def components(pairs, nodes):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def brute_links(x, threshold=0.9):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    return near


@pytest.mark.parametrize("dims", [12, 64])
def test_embedding_links(spark, dims):
    """Recall of pairs just above the threshold, planted among other vectors; none below it."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(1500, dims))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=(300, dims))
    side -= (side * base[:300]).sum(1, keepdims=True) * base[:300]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = rng.uniform(0.901, 0.93, size=(300, 1))
    x = np.concatenate([base, c * base[:300] + np.sqrt(1 - c**2) * side, np.repeat(base[400:401], 30, 0), base[500] + rng.normal(size=(60, dims)) * 0.3 / np.sqrt(dims)])
    near = brute_links(x)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["id"]: r for r in embeddings.near_vectors(frame).collect()}
    assert len(got) == len(x) and all(got[i]["n_links"] <= near[i].sum() for i in range(len(x)))
    planted = [i for i in range(1500, 1800)]
    assert np.mean([got[i]["n_links"] >= 1 for i in planted]) >= 0.95
    assert sum(got[i]["n_links"] for i in range(len(x))) >= 0.95 * near.sum()
    want = {(i, j) for i, j in zip(*np.nonzero(near), strict=True)}
    whole = components(want, range(len(x)))
    assert np.mean([got[i]["component_id"] == whole[i] for i in range(len(x))]) >= 0.95


def test_embedding_rows_of_all_kinds(spark):
    """Repeated ids with other vectors, lengths of their own, odd vectors, clashing columns, no rows."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3, 32))
    near = v[1] + rng.normal(size=32) * 0.02
    rows = [(1, v[0]), (1, v[1]), (2, near), (3, v[2]), (3, v[2]), (None, v[2]), (10, v[0][:7]), (11, 2 * v[0][:7]), (12, [1.0]), (13, [3.0]), (14, [-1.0])]
    rows = [(i, [float(a) for a in x]) for i, x in rows] + [(900, None), (901, [0.0] * 32), (902, [float("nan")] + [1.0] * 31), (903, [None] + [1.0] * 31), (904, []), (905, [float("inf")] * 32)]
    frame = spark.createDataFrame([(i, x, 0, 0, 0) for i, x in rows], "vec_id long, embedding array<double>, id int, node int, vector int")
    got = sorted(((r["id"] is not None, r["id"] or 0), r["n_links"], r["component_id"]) for r in embeddings.near_vectors(frame).collect())
    want = [(None, 0, None), (1, 0, 1), (1, 1, 1), (2, 1, 1), (3, 1, 3), (3, 1, 3), (10, 1, 10), (11, 1, 10), (12, 1, 12), (13, 1, 12), (14, 0, 14), *[(i, 0, i) for i in range(900, 906)]]
    assert got == [((i is not None, i or 0), n, c) for i, n, c in want]
    assert embeddings.near_vectors(frame.where("false")).isEmpty()


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def test_near_duplicates(spark):
    rows = rows_of([*sample(80, words=120), *["same " * 9 + "text"] * 40]) + ODD
    sets = {i: shingle_set(t) for i, t, _ in rows if i is not None}
    ids = sorted(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    whole, degree = components(pairs, ids), Counter(x for p in pairs for x in p)
    got = {r["id"]: (r["class_id"], r["n_links"]) for r in neardup.near_duplicates(docs(spark, rows)).collect()}
    assert {i: got[i][0] for i in ids} == whole
    assert {i: got[i][1] for i in ids if i != 503} == {i: degree[i] for i in ids if i != 503}
    assert neardup.near_duplicates(docs(spark, []).where("false")).isEmpty()


def test_bayesian_pruning_keeps_similar_pairs():
    for seen, need in zip(range(neardup.STEP, neardup.HASHES + 1, neardup.STEP), neardup.NEED, strict=True):
        t = 0.8
        missed = sum(math.comb(seen, m) * t**m * (1 - t) ** (seen - m) for m in range(need))
        assert missed < 1e-3


def test_components_of_a_long_path(spark):
    links = spark.range(200).selectExpr("id + 1 AS src", "id AS dst")
    found = connected_components(links, Workspace(spark), "path").collect()
    assert len(found) == 201 and {r["component"] for r in found} == {0}


def test_mixing(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "w " * int(n), "abcd"[int(k)]) for i, (n, k) in enumerate(zip(rng.integers(1, 200, 900), rng.choice(4, 900, p=[0.7, 0.1, 0.1, 0.1]), strict=True))] + [(2000, "null source", None), *ODD[1:]]
    got = mixing.mix_sources(docs(spark, rows)).collect()
    assert sum(r["n_rows"] for r in got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
    sizes = {s: sum(r["size"] * r["n_rows"] for r in part) for s, part in by.items()}
    order, weights = sorted((s for s in by if s is not None)) + [None], {}
    for k, s in enumerate(order):
        weights[s] = (5, 2, 1)[k % 3]
    want, left, open_ = {}, 1.5 * sum(sizes.values()), list(order)
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = [s for s in open_ if level * weights[s] > 2 * sizes[s]]
        if not full:
            want |= {s: level * weights[s] for s in open_}
            break
        for s in full:
            want[s] = 2.0 * sizes[s]
            left -= want[s]
            open_.remove(s)
    for s, part in by.items():
        assert part[0]["target"] == pytest.approx(want[s]) and part[0]["source_size"] == sizes[s]
        taken = sum(r["copies"] * r["size"] * r["n_rows"] for r in part)
        assert abs(taken - want[s]) <= max(0.01 * want[s], 200 if s != "b" else 60_000)
        assert all(0 <= r["copies"] <= 2 for r in part)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs(spark, rows).repartition(7)).collect()))
    assert mixing.mix_sources(docs(spark, []).where("false")).isEmpty()


def test_words_are_counted(spark):
    texts = ["a b", " a\tb\r\n", None, "", "\x0b\x0c", "é\xa0x y", "a\x1cb"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(count_words(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in got] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def similar_lines(rows):
    """(document, line) of all lines that a brute-force search would remove."""
    found, gone = [], set()
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        for n, line in enumerate((t or "").split("\n") if t is not None else []):
            own = set(re.findall(r"[^\x20\x09-\x0D]+", line.lower()))
            if own:
                if any(len(own & o) >= 0.8 * len(own | o) - 1e-9 for o in found):
                    gone.add((i, n))
                found.append(own)
    return gone


def test_line_dedup(spark):
    rng = np.random.default_rng(7)
    template = [f"t{i}" for i in range(20)]
    lines_ = [" ".join(rng.choice(VOCABULARY, int(rng.integers(1, 25)))) for _ in range(200)] + [" ".join([*template[:k], f"v{k}{j}", *template[k + 1 :]]) for k in range(12) for j in range(6)]
    rng.shuffle(lines_)
    rows = [(i, "\n".join(lines_[i::20]), "a") for i in range(20)] + [(30, "same line here\n\nsame line here", "a"), *[r for r in ODD if r[0] not in (503, 504)]]
    frame = docs(spark, rows)
    got = {(r["id"], n) for r in lines.repeated_lines(frame).collect() for n in r["removed"]}
    assert got == similar_lines(rows)
    kept = {r["doc_id"]: r for r in lines.dedup_lines(frame).collect()}
    assert kept[30]["text"] == "same line here\n" and kept[500]["text"] is None and kept[30]["shard"] == "x"
    assert lines.dedup_lines(frame).count() == len(rows)
    assert lines.repeated_lines(frame.where("false")).isEmpty()


def test_repeated_rows_are_one_document_for_lines(spark):
    frame = docs(spark, [(1, "one line", "a"), (1, "one line", "a"), (2, "one line", "a")])
    assert [(r["id"], r["removed"]) for r in lines.repeated_lines(frame).collect()] == [(2, [0])]


@pytest.mark.parametrize("slack", [0.0, 0.1])
def test_sharding(spark, slack):
    rows = rows_of(sample()) + ODD
    frame = docs(spark, rows)
    got = sharding.shard_documents(frame, 8, slack=slack).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["text_crc32"] == zlib.crc32((r["text"] or "").encode()) and r["size"] == len((r["text"] or "").encode()) + 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by.get(s, [])) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1 if slack == 0 else max(sizes) <= -(-1.1 * len(rows) // 8)
    assert sharding.shard_documents(frame.where("false")).isEmpty()


def test_growing_moves_few_rows(spark):
    frame = spark.range(4000).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    before = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(frame, 8, slack=0.25, vnodes=64).collect()}
    after = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(frame, 9, slack=0.25, vnodes=64).collect()}
    assert sum(before[i] != after[i] for i in before) < 0.4 * len(before)


def test_decontamination_guarantee(spark):
    item = " ".join(f"i{k}" for k in range(30))
    rows = [(1, "x " + " ".join(f"i{k}" for k in range(5, 15)) + " y", "a"), (2, " ".join(f"i{k}" for k in range(5, 14)), "a"), (3, "Short, ITEM?", "a"), (4, item + "! " + item, "a"), *ODD]
    items = spark.createDataFrame([("a", item, 1), ("b", "short item", 1), ("c", None, 1), ("d", "?!", 1), (None, "x", 1)], "item_id string, text string, doc_id int")
    got = {r["id"]: r for r in decontaminate.find_leaks(docs(spark, rows), items).collect()}
    assert [(got[i]["n_hit"], got[i]["items"]) for i in (1, 2, 3, 4)] == [(11, ["", "a"]), (0, []), (2, ["b"]), (60, ["a"])]
    assert got[503]["n_rows"] == 2 and got[500]["n_words"] == 0
    assert decontaminate.find_leaks(docs(spark, rows), items.where("false")).where("n_hit > 0").isEmpty()


def auc(rows):
    pos, neg = ([s for s, y in rows if y == k] for k in (1, 0))
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


@pytest.mark.parametrize(("name", "label"), [("op9_toxicity", "toxic"), ("op10_quality", "quality")])
def test_classifiers_on_held_out_rows(spark, name, label):
    sf = SF.replace("0.001", "0.01")
    marks = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES[name](spark, sf).collect()
    held = [(r["score"], marks[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in marks]
    assert auc(held) > 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_identity_terms_do_not_move_scores(spark):
    rows = [(i, f"those {g} are vile scum number{i % 7}" if i % 2 else f"the {g} met in the park number{i % 7}", "a") for i, g in enumerate(["women"] * 80 + ["men", "girls"] * 20)]
    labels = spark.createDataFrame([(i, i % 2) for i, _, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, rows), labels)
    ask = docs(spark, [(1, "the women met in the park", "a"), (2, "the men met in the park", "a"), (3, "those men are vile scum", "a"), *ODD])
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(ask, model).collect()}
    assert abs(got[1]["score"] - got[2]["score"]) < 0.05 and got[3]["predicted"] == 1 and got[1]["predicted"] == 0
    assert got[500]["score"] == got[501]["score"] and got[1]["shard"] == "x"


def test_swap_penalty_lowers_false_positives(spark):
    """Toxic sentences name one group far more often than another: the plain fit takes the group for a sign of toxicity."""
    rows = []
    for i in range(400):
        toxic = i % 2
        group = ("muslim" if i % 20 < 18 else "christian") if toxic else ("christian" if i % 20 < 18 else "muslim")
        # four in ten say nothing but the group, so only that is left to go by
        text = f"here come {group} folk" if i // 2 % 5 < 2 else f"those {group} folk are vile scum" if toxic else f"the {group} folk met in the park"
        rows.append((i, f"{text} number{i % 7}", "a"))
    labels = spark.createDataFrame([(i, i % 2) for i, _, _ in rows], "doc_id long, toxic int")
    ask = docs(spark, [(1, "here come muslim folk", "a"), (2, "here come christian folk", "a"), (3, "those muslim folk are vile scum", "a"), (4, "those christian folk are vile scum", "a")])

    def scores(penalty):
        model = toxicity.fit(docs(spark, rows), labels, swap_penalty=penalty)
        return model, {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(ask, model).collect()}

    (plain, before), (fair, after) = scores(0.0), scores(4.0)
    assert plain.n_swaps == fair.n_swaps > 0
    assert before[1] - before[2] > 0.1 and abs(after[1] - after[2]) < (before[1] - before[2]) / 3
    assert before[1] > 0.7 > max(after[1], after[2]) and min(after[3], after[4]) > 0.7  # a neutral mention is no more rejected


def test_quality_edges(spark):
    model = quality.fit(docs(spark, []).where("false"), spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.score_quality(docs(spark, ODD), model).count() == len(ODD)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    expected, df = c.sql(ORACLE_SQL[name]), QUERIES[name](spark, SF)
    names = expected.columns
    assert sorted(map(str, expected.fetchall())) == sorted(str(tuple(r)) for r in df.select(*names).collect())
