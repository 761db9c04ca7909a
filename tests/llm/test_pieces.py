import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import pieces as P

tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path(P.MODEL)


@pytest.fixture(scope="module")
def model():
    return P.Model.load(PATH)


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=PATH)


def same(model, library, texts):
    got = [i.tolist() for i in P.encode(model, texts)]
    want = library.encode(texts, num_threads=1)
    assert got == want
    assert [P.decode(model, np.array(i, dtype=np.int64)).decode() for i in got] == [library.decode(i) for i in want]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_any_text(model, library, texts):
    same(model, library, texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" ▁abeint\n", max_size=300), max_size=4))
def test_runs_of_few_characters(model, library, texts):
    """Pairs that overlap, spaces of equal scores, words around the length from which a heap takes over."""
    same(model, library, texts)


def test_edges(model, library):
    same(model, library, ["", " ", "  ", "a", " a ", "▁", "\0", "é é", "日本語のテキスト", "\U0001f600" * 5, "ﬁ Ⅳ", "x" * 127, "x" * 128, "x" * 129, " " * 127 + "x" + " " * 200, "<s>", "<0x41>", "<unk>"])


def test_blocks_do_not_show(model, library, monkeypatch):
    """Texts are cut between words into blocks; one without such a place stays whole."""
    r = random.Random(3)
    texts = [" ".join("".join(r.choice("etaoinshr") for _ in range(r.randint(1, 9))) for _ in range(300)), "ab" * 400, "", "日本 " * 100]
    monkeypatch.setattr(P, "BLOCK", 64)
    same(model, library, texts)


def test_decoding_of_any_ids(model, library):
    r = random.Random(4)
    for _ in range(300):
        ids = [r.choice([0, 1, 2, r.randrange(3, 259), r.randrange(259, 32000)]) for _ in range(r.randrange(12))]
        assert P.decode(model, np.array(ids, dtype=np.int64)).decode() == library.decode(ids), ids


def test_documents(spark, library):
    rows = [(1, "Hello  world\n"), (2, None), (2, ""), (None, "x"), (1, "Hello  world\n"), (3, "tok ens " * 30_000)]
    df = spark.createDataFrame([(i, t, "mine") for i, t in rows], "doc_id long, text string, ids string")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(i, len(ids := library.encode(t or "")), sha(",".join(map(str, ids))), sha(library.decode(ids))) for i, t in rows]
    assert sorted(map(tuple, P.digest_documents(df, model=PATH).collect()), key=repr) == sorted(want, key=repr)
    full = {(r["doc_id"], r["decoded"]): r["ids"] for r in P.encode_documents(df, model=PATH).collect()}
    assert full[(1, "Hello  world\n")] == library.encode("Hello  world\n") and full[(2, "")] == []
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert P.digest_documents(empty, model=PATH).collect() == []


def test_models_that_change_texts_are_refused(monkeypatch, library):
    monkeypatch.setattr(type(library), "normalize", lambda self, x: x.upper())
    with pytest.raises(ValueError, match="changes texts"):
        P.Model.load(PATH)
