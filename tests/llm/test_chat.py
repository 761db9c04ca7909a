"""op2 holds a turn at a time: results across batches, against a conversation encoded whole, and its memory."""

import hashlib
import tracemalloc

import numpy as np
import pandas as pd

from tallyspark.llm import chat
from tallyspark.llm.queries import QUERIES

PARTS = ["<|im_end|>", "<|im_start|>", "<|im_sep|>", "<\\|", "<|", "|>", "<|endoftext|>", " ", "\n", "  x", "é", "漢字", "🙂", "word", " word", "'s", "12", "", "<"]


def odd_turns(n, seed=0):
    rng = np.random.default_rng(seed)
    return [(("assistant", "user", "system", "")[rng.integers(4)], "".join(rng.choice(PARTS, rng.integers(0, 9)))) for _ in range(n)]


def batches(rows, size):
    return (pd.DataFrame(rows[i : i + size], columns=["conv_id", "role", "text"]) for i in range(0, len(rows), size))


def expected(turns):
    loss = "".join(x for role, x in turns if role == "assistant")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss), len(chat.render(turns)[0])


def test_turns_are_the_conversation_encoded_whole(monkeypatch):
    """Ids, offsets and mask of turns put together, whatever the batches and frames cut."""
    convs = {"a": odd_turns(40), None: odd_turns(3, 1), "b": odd_turns(1, 2), "c": odd_turns(25, 3)}
    rows = [(c, r, x) for c, turns in convs.items() for r, x in turns]
    t = chat.load_tokenizer(chat.TOKENIZER)
    for size, frame in ((1, 1), (7, 300), (1000, 1 << 22)):
        monkeypatch.setattr(chat, "FRAME_CHARS", frame)
        got = [r for part in chat.fold_turns(batches(rows, size), chat.TOKENIZER, chat.Whole) for r in part.itertuples(index=False)]
        assert [r.conv_id for r in got] == list(convs)
        for r, turns in zip(got, convs.values(), strict=True):
            text, spans = chat.render(turns)
            e = t.encode(text, add_special_tokens=False)
            starts, ends = np.array(e.offsets).T
            assert (r.formatted, r.token_ids.tolist(), r.token_starts.tolist(), r.token_ends.tolist()) == (text, e.ids, starts.tolist(), ends.tolist())
            assert r.loss_mask.tolist() == chat.mask_tokens(starts, ends, spans).tolist()
        folded = [tuple(r)[1:] for part in chat.fold_turns(batches(rows, size), chat.TOKENIZER, chat.Digest) for r in part.itertuples(index=False)]
        assert folded == [expected(turns) for turns in convs.values()]


def test_covered_merges_ranges():
    rng = np.random.default_rng(4)
    for n in range(0, 60):
        starts = np.sort(rng.integers(0, 80, n))
        ends = np.sort(starts + rng.integers(0, 4, n))
        mask = rng.random(n) < 0.6
        want = []
        for lo, hi in zip(starts[mask].tolist(), ends[mask].tolist(), strict=True):
            if want and lo <= want[-1][1]:
                want[-1] = (want[-1][0], max(want[-1][1], hi))
            else:
                want.append((lo, hi))
        assert chat.covered(starts, ends, mask) == want


def test_memory_stays_with_the_turn(monkeypatch):
    """A conversation of 2,000 turns, and 400 conversations of 5 turns in one batch, take a few MB of tokens at most."""
    rng = np.random.default_rng(5)
    text = lambda: " ".join(map(str, rng.integers(0, 1 << 40, 40)))
    chat.load_tokenizer(chat.TOKENIZER)
    monkeypatch.setattr(chat, "FRAME_CHARS", 20_000)
    for into, rows, size in ((chat.Digest, [("a", "assistant", text()) for _ in range(2000)], 100), (chat.Whole, [(str(i // 5), "assistant", text()) for i in range(2000)], 2000)):
        parts = batches(rows, size)
        tracemalloc.start()
        n = sum(len(part) for part in chat.fold_turns(parts, chat.TOKENIZER, into))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n == len({c for c, _, _ in rows})
        assert peak < 4e6


def test_query_collects_no_conversation(spark):
    plan = QUERIES["op2_chat"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
    assert plan.count("MapInPandas") == 1
    assert "ArrowEvalPython" not in plan


def test_query_across_batches(spark, tmp_path):
    """Long conversations, ties, nulls and repeated rows through batches of three turns."""
    rows = [(c, t // 2, r, x) for c in (1, 2, 3, None) for t, (r, x) in enumerate(odd_turns(30, 10 + (c or 0)))]
    rows += [(4, None, "user", "first"), (4, 0, None, None), (4, 0, None, None), (4, 0, "assistant", "b"), (4, 0, "assistant", "a")]
    rng = np.random.default_rng(6)
    spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    own = "<|im_end|><|im_start|>assistant ok"
    rows += [(-1, 0, "user", own), (-1, 1, "assistant", own)]
    key = lambda x: (x[1] is not None, x[1] or 0, (x[2] or "").encode(), (x[3] or "").encode())
    want = {c: expected([(r or "", x or "") for _, _, r, x in sorted((y for y in rows if y[0] == c), key=key)]) for c in {x[0] for x in rows}}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = QUERIES["op2_chat"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(want)
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == want
