"""LM scoring with an Elias-Fano n-gram trie of three levels.

Counting: every task cuts its texts into words, numbers them by hash and sends, for each shard of pairs, its
distinct word triples with counts, and its word counts to the words' shards; each token but an end is the first
of one triple, so triples give the counts of pairs too. The shard of a pair comes from both its words, so the
successors of a frequent word are spread over many shards. One task for each shard adds up and writes a file:

  heads       Elias-Fano sequence of the hashes of first words
  pointers2   Elias-Fano sequence: where the second words of a first word begin
  successors2 for each first word the hashes of its second words, raised by the last value of the word before,
              which makes the whole level one ascending Elias-Fano sequence
  pointers3, successors3 the same for the third words of each pair
  gain2, gain3, rest3 smoothed probabilities and back-off weights, as bytes into tables of 256 values

Words with their counts (a running Elias-Fano sequence) and back-off weights make files of their own, from the
sums of all shards. Scoring maps the files into memory and, for each batch of texts, looks up distinct words,
pairs and triples only: a successor is searched relative to its context's range. All whole texts, pairs and
triples count, those seen once as well; nothing is pruned.

Probabilities, with c the counts, d the discount and n the number of distinct followers:
  p(w)       = (c(w) - d1) / N; the d1 * V / N that this frees is shared by as many unseen words as there are
               known ones, or by more, so that an unseen word is less likely than one seen once
  p(w | v)   = (c(vw) - d) / c(v) + d * n(v) / c(v) * p(w)
  p(w | u v) = (c(uvw) - d) / c(uv) + d * n(uv) / c(uv) * p(w | v)
A first part is 0 where the sequence was never seen, and a context never seen leaves the shorter one's
probability. The first token of a text has no context.
"""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._work import Workspace, table
from .eliasfano import EliasFano, from_buffer, quantise, to_bytes
from .quality import id_hash

DISCOUNT = 0.75
#: Text bytes for each shard, which bounds what one task builds, as long as shards are not more than MOST_SHARDS.
SHARD_BYTES, MOST_SHARDS_LOG2 = 16_000_000, 16
#: Words are in 2 ** HOME_BITS files at most.
HOME_BITS = 8
#: Tokens that a task counts, or scores, at once. Three numbers below COUNT_TOKENS + 4 fit into 64 bits.
COUNT_TOKENS, SCORE_TOKENS = 2_000_000, 1_000_000
#: Bits of a word's hash: in contexts (a hundred pairs of a billion words may be one there), and relative to a
#: context (a word that never followed it is taken for one of its n followers with probability n / 2 ** 32).
WORD_BITS, SUCCESSOR_BITS = 52, 32
CACHE = 400_000
NONE = np.uint32(0xFFFFFFFF)
END = xxhash.xxh3_64_intdigest(b"")  # no word is empty
U = np.uint64


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def tokens(self, text: str | None) -> list[int]:
        """Hashes of the words (A-Z lowered, as bytes.lower does; bytes.split cuts at [\\x20\\x09-\\x0D]) and of the end."""
        out = list(map(self.__getitem__, (text or "").encode("utf-8", "replace").lower().split()))
        out.append(END)
        return out


def pack(values: np.ndarray) -> bytes:
    """Numbers as planes of their bytes, compressed: most high bytes are 0."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(packed: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.uint8) if packed else np.empty(0, dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def top_bits(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), dtype=np.int64)


def pair_shard(first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    """Half of the bits from the first word, so that few shards hold a rare one, the rest from the second."""
    low = bits // 2
    return (top_bits(first, bits - low) << low) | top_bits((second ^ (second >> U(32))) * U(0x9E3779B97F4A7C15), low)


def pack_words(words: np.ndarray) -> bytes:
    """Ascending hashes, as steps."""
    return pack(np.diff(words, prepend=U(0)))


def unpack_words(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack(packed, U), dtype=U)


def local(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(the numbers in use, ascending; where each of ids is among them)."""
    used = np.zeros(size, dtype=bool)
    used[ids] = True
    return np.flatnonzero(used), (np.cumsum(used, dtype=np.int64) - 1)[ids]


def ngram_rows(hashes: np.ndarray, n: int, bits: int) -> pd.DataFrame:
    """Triples that begin with the first n of hashes (texts, each with its end), and counts of these words: a row
    for each shard. Up to two hashes more tell how the last ones go on."""
    words, ids = np.unique(hashes, return_inverse=True)
    none, end = len(words), np.searchsorted(words, U(END))
    follow = np.append(ids[1:], none)
    follow[ids == end] = none
    a, b, c = ids[:n], follow[:n], np.append(follow[1:], none)[:n]
    keep = b != none
    step = U(none + 1)
    key, counts = np.unique((a[keep].astype(U) * step + b[keep].astype(U)) * step + c[keep].astype(U), return_counts=True)
    third, pair = (key % step).astype(np.int64), key // step
    second, first = (pair % step).astype(np.int64), (pair // step).astype(np.int64)
    shard = pair_shard(words[first], words[second], bits)
    order = np.argsort(shard, kind="stable")  # within a shard triples stay in order
    cuts = np.append(np.flatnonzero(np.diff(shard[order], prepend=-1)), len(order))
    rows: dict[int, dict[str, bytes]] = {}
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        at = order[lo:hi]
        x, y, z = first[at], second[at], third[at]
        known = z != none
        used, place = local(np.concatenate([x, y, z[known]]), none)
        zz = np.full(hi - lo, NONE, dtype=np.uint32)
        zz[known] = place[2 * (hi - lo) :]
        x, y = place[: hi - lo], place[hi - lo : 2 * (hi - lo)]
        starts = np.flatnonzero((np.diff(x, prepend=-1) != 0) | (np.diff(y, prepend=-1) != 0))
        fan = np.diff(np.append(starts, hi - lo))
        rows[int(shard[at[0]])] = {"words": pack_words(words[used] >> U(64 - WORD_BITS))} | {k: pack(v.astype(np.uint32)) for k, v in (("first", np.diff(x[starts], prepend=0)), ("second", y[starts]), ("fan", fan), ("third", zz), ("counts", counts[at]))}
    seen = np.bincount(a, minlength=none)
    own = np.flatnonzero(seen)
    home = top_bits(words[own], bits)  # ascending, as words are
    cuts = np.append(np.flatnonzero(np.diff(home, prepend=-1)), len(own))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        rows.setdefault(int(home[lo]), {}).update({"own": pack_words(words[own[lo:hi]]), "own_counts": pack(seen[own[lo:hi]].astype(np.uint32))})
    return pd.DataFrame([{"shard": s} | {k: r.get(k, b"") for k in ROW} for s, r in rows.items()])


ROW = ("words", "first", "second", "fan", "third", "counts", "own", "own_counts")


def count_ngrams(bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, held, n = Words(), [], 0
        for batch in batches:
            for text in batch["text"]:
                held.append(np.array(cache.tokens(text), dtype=U))
                n += len(held[-1])
                if n >= COUNT_TOKENS + 2:
                    tokens, at = np.concatenate(held), 0
                    while len(tokens) - at >= COUNT_TOKENS + 2:
                        yield ngram_rows(tokens[at : at + COUNT_TOKENS + 2], COUNT_TOKENS, bits)
                        at += COUNT_TOKENS
                    held, n = [tokens[at:].copy()], len(tokens) - at
        if n:
            tokens = np.concatenate(held)
            yield ngram_rows(tokens, len(tokens), bits)

    return run


def raised(second: np.ndarray, fan: np.ndarray) -> EliasFano:
    """Values that ascend within ranges of lengths fan, raised to ascend throughout; none is 0."""
    ends = np.cumsum(fan)
    some = np.flatnonzero(fan)
    last = np.zeros(len(fan), dtype=U)
    last[some] = second[ends[some] - 1] + U(1)
    return EliasFano.build(np.repeat(np.cumsum(last) - last, fan) + second + U(1))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with their summed counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def build_trie(rows: pd.DataFrame) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Arrays of one shard's trie; the first words and the number of their pairs."""
    rows = rows[rows["words"].str.len() > 0]
    words = [unpack_words(x) for x in rows["words"]]
    everything = np.unique(np.concatenate([*words, np.empty(0, dtype=U)]))
    pairs, thirds = [np.empty(0, dtype=U)], [np.empty(0, dtype=np.uint32)]
    for w, x, y, fan, z in zip(words, *[rows[c] for c in ("first", "second", "fan", "third")], strict=True):
        place = np.append(np.searchsorted(everything, w), int(NONE)).astype(U)
        x, y, fan, z = (unpack(part, np.uint32) for part in (x, y, fan, z))
        pairs.append(np.repeat((place[np.cumsum(x)] << U(32)) | place[y], fan))
        thirds.append(place[np.minimum(z, len(w))].astype(np.uint32))
    pairs, thirds = np.concatenate(pairs), np.concatenate(thirds)
    pair_keys, pair_of = np.unique(pairs, return_inverse=True)
    del pairs
    keys, counts = summed((pair_of.astype(U) << U(32)) | thirds, np.concatenate([np.empty(0, dtype=np.uint32), *[unpack(x, np.uint32) for x in rows["counts"]]]))
    del thirds
    pair_of, third = (keys >> U(32)).astype(np.int64), keys & U(0xFFFFFFFF)
    pair_counts = np.bincount(pair_of, counts, len(pair_keys)).astype(np.int64)
    keep = third != U(int(NONE))
    pair_of, third, counts = pair_of[keep], everything[third[keep].astype(np.int64)] >> U(WORD_BITS - SUCCESSOR_BITS), counts[keep]
    fan3 = np.bincount(pair_of, minlength=len(pair_keys))
    first, second = (pair_keys >> U(32)).astype(np.int64), everything[(pair_keys & U(0xFFFFFFFF)).astype(np.int64)] >> U(WORD_BITS - SUCCESSOR_BITS)
    heads, fan2 = np.unique(first, return_counts=True)
    codes = {"gain2": np.log10(pair_counts - DISCOUNT), "gain3": np.log10((counts - DISCOUNT) / pair_counts[pair_of]), "rest3": np.log10(np.maximum(fan3, 1) * DISCOUNT / pair_counts)}
    parts = EliasFano.build(everything[heads]).parts("heads") | EliasFano.build(np.append(0, np.cumsum(fan2))).parts("pointers2") | raised(second, fan2).parts("successors2")
    parts |= EliasFano.build(np.append(0, np.cumsum(fan3))).parts("pointers3") | raised(third, fan3).parts("successors3")
    for name, values in codes.items():
        parts[name], parts[f"{name}_book"] = quantise(values)
    return parts, everything[heads], fan2


def shared_files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_file(root: str, name: str, parts: dict[str, np.ndarray]) -> str:
    files, folder = shared_files(root)
    files.create_dir(folder, recursive=True)
    name = f"{name}-{uuid.uuid4().hex}.trie"  # a task that runs twice leaves two files; the table names one
    with files.open_output_stream(f"{folder}/{name}") as out:
        out.write(to_bytes(parts))
    return name


def write_pairs(root: str, homes: int):
    """Writes a shard of pairs; gives its file and, for each file of words, the counts of its own words and the fans
    of its first words."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0])
        parts, heads, fan = build_trie(rows)
        name = write_file(root, f"pairs-{shard:06d}", parts)
        counts = [unpack(x, np.uint32) for x in rows["own_counts"]]
        own, counts = summed(np.concatenate([unpack_words(x) for x in rows["own"]]), np.concatenate(counts))
        out = [{"shard": shard, "home": -1, "file": name}]
        heads = heads << U(64 - WORD_BITS)
        for home in range(1 << homes):
            mine, met = (x[lo:hi] for x, (lo, hi) in ((x, np.searchsorted(top_bits(x, homes), [home, home + 1])) for x in (own, heads)))
            if len(mine) or len(met):
                at, ft = np.searchsorted(own, mine), np.searchsorted(heads, met)
                out.append({"shard": shard, "home": home, "file": "", "words": pack_words(mine), "counts": pack(counts[at]), "heads": pack_words(met), "fans": pack(fan[ft].astype(np.int64))})
        return pd.DataFrame(out, columns=["shard", "home", "file", "words", "counts", "heads", "fans"])

    return run


def write_words(root: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        home = int(rows["home"].iloc[0])
        gather = lambda words, values: summed(np.concatenate([unpack_words(x) for x in rows[words]]), np.concatenate([unpack(x, np.int64) for x in rows[values]]))
        words, count = gather("words", "counts")
        heads, fans = gather("heads", "fans")
        fan = np.zeros(len(words), dtype=np.int64)
        fan[np.searchsorted(words >> U(64 - WORD_BITS), heads >> U(64 - WORD_BITS))] = fans
        parts = EliasFano.build(words).parts("words") | EliasFano.build(np.cumsum(count)).parts("counts")
        parts["rest2"], parts["rest2_book"] = quantise(np.log10(np.where(fan > 0, fan * DISCOUNT / count, 1.0)))
        name = write_file(root, f"words-{home:06d}", parts)
        return pd.DataFrame([{"home": home, "file": name, "words": len(words), "tokens": int(count.sum()), "once": int((count == 1).sum()), "twice": int((count == 2).sum())}])

    return run


def mapped(root: str, name: str) -> np.ndarray:
    """A file of the shared folder in memory: mapped where the folder is a mounted one, else through a copy, once for
    each worker process, that goes with the process."""
    from pyarrow import fs

    files, folder = shared_files(root)
    if isinstance(files, fs.LocalFileSystem):
        return np.memmap(f"{folder}/{name}", dtype=np.uint8, mode="r")
    handle, path = tempfile.mkstemp()
    with files.open_input_stream(f"{folder}/{name}") as read, os.fdopen(handle, "wb") as out:
        while part := read.read(1 << 22):
            out.write(part)
    try:
        return np.memmap(path, dtype=np.uint8, mode="r")
    finally:
        os.unlink(path)


def unseen_words(n_words: int, discount: float) -> int:
    return max(n_words, int(n_words * discount / (1 - discount))) + 1


class Model:
    """All shards, mapped into memory when they are first asked."""

    def __init__(self, root: str, pairs: dict[int, str], words: dict[int, str], bits: int, sums: dict[str, int]):
        self.root, self.pairs, self.words, self.bits, self.sums = root, pairs, words, bits, sums
        once, twice = sums["once"], sums["twice"]
        self.discount = min(max(once / (once + 2 * twice) if once else 0.5, 0.1), 0.9)
        # functions come to a worker by value, so what it keeps from task to task hangs on a module of its own
        self.open = sys.__dict__.setdefault("_tallyspark_tries", {})
        for key in [k for k in self.open if k[0] != root]:
            del self.open[key]

    def part(self, names: dict[int, str], shard: int) -> dict[str, np.ndarray] | None:
        if shard not in names:
            return None
        key = (self.root, names[shard])
        if key not in self.open:
            self.open[key] = from_buffer(mapped(*key))
        return self.open[key]

    def shards(self, names: dict[int, str], shard: np.ndarray) -> Iterator[tuple[dict, np.ndarray]]:
        """Shards, and which of the questions go to them."""
        order = np.argsort(shard.astype(np.uint16), kind="stable")  # MOST_SHARDS_LOG2 bits, which sort by counting
        cuts = np.append(np.flatnonzero(np.diff(shard[order], prepend=-1)), len(order))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            part = self.part(names, int(shard[order[lo]]))
            if part is not None:
                yield part, order[lo:hi]

    def score(self, texts: list[np.ndarray]) -> pd.DataFrame:
        """n_tokens, n_known, base_score and score of texts given as word hashes, each with its end."""
        n_all, n_words = self.sums["tokens"], self.sums["words"]
        tokens = np.concatenate(texts)
        lengths = np.array([len(t) for t in texts])
        starts = np.cumsum(lengths) - lengths
        words, ids = np.unique(tokens, return_inverse=True)
        counts, rest2 = np.zeros(len(words), dtype=np.int64), np.zeros(len(words))
        for part, at in self.shards(self.words, top_bits(words, min(self.bits, HOME_BITS))):
            rank, known = EliasFano.of(part, "words").successor(words[at])
            at, r = at[known], rank[known]
            running = EliasFano.of(part, "counts")
            counts[at] = running.get(r).astype(np.int64) - np.where(r > 0, running.get(np.maximum(r - 1, 0)).astype(np.int64), 0)
            rest2[at] = part["rest2_book"][part["rest2"][r]]
        unknown = self.discount * n_words / n_all / unseen_words(n_words, self.discount) if n_all else 1.0
        single = np.where(counts > 0, (counts - self.discount) / max(n_all, 1), unknown)

        order = np.ones(len(tokens), dtype=np.int64)  # how many tokens of context each has, two at most
        order[starts] = 0
        order[1:] += order[1:] & order[:-1]
        follow = np.flatnonzero(order > 0)
        keys, pair_at = np.unique(ids[follow - 1] * len(words) + ids[follow], return_inverse=True)
        first, second = keys // len(words), keys % len(words)
        pair_of = np.zeros(len(tokens), dtype=np.int64)
        pair_of[follow] = pair_at
        deep = np.flatnonzero(order > 1)
        keys, where, triple_at = np.unique(pair_of[deep - 1] * len(words) + ids[deep], return_index=True, return_inverse=True)
        context, third, inner = keys // max(len(words), 1), keys % max(len(words), 1), pair_of[deep[where]]
        gain2, rest3, gain3 = np.zeros(len(first)), np.zeros(len(first)), np.zeros(len(third))
        of_context = np.searchsorted(context, np.arange(len(first) + 1))
        for part, at in self.shards(self.pairs, pair_shard(words[first], words[second], self.bits)):
            pointers, level2, level3 = EliasFano.of(part, "pointers2"), EliasFano.of(part, "successors2"), EliasFano.of(part, "successors3")
            rank, known = EliasFano.of(part, "heads").successor(words[first[at]] >> U(64 - WORD_BITS))
            at, r = at[known], rank[known]
            place, at = self.within(level2, pointers, r, words[second[at]], at)
            gain2[at] = 10 ** part["gain2_book"][part["gain2"][place]] / np.maximum(counts[first[at]], 1)
            rest3[at] = part["rest3_book"][part["rest3"][place]]
            rest3[at[words[second[at]] == U(END)]] = 0.0
            n_asked = of_context[at + 1] - of_context[at]
            asked = np.repeat(of_context[at], n_asked) + np.arange(n_asked.sum()) - np.repeat(np.cumsum(n_asked) - n_asked, n_asked)
            found, asked = self.within(level3, EliasFano.of(part, "pointers3"), np.repeat(place, n_asked), words[third[asked]], asked)
            gain3[asked] = 10 ** part["gain3_book"][part["gain3"][found]]
        double = np.minimum(gain2 + 10 ** rest2[first] * single[second], 1.0)
        triple = np.minimum(gain3 + 10 ** rest3[context] * double[inner], 1.0)
        value = np.log10(single)[ids]
        value[follow] = np.log10(double)[pair_at]
        value[deep] = np.log10(triple)[triple_at]
        plain = np.log10((counts + 1) / (n_all + n_words + 1))[ids]
        return pd.DataFrame({"n_tokens": lengths, "n_known": np.add.reduceat((counts > 0).astype(np.int64)[ids], starts), "base_score": np.add.reduceat(plain, starts), "score": np.add.reduceat(value, starts)})

    @staticmethod
    def within(level: EliasFano, pointers: EliasFano, rank: np.ndarray, want: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Search words among the successors of contexts (by rank): (places, at) of those that are there."""
        if not len(rank):
            return rank, at
        begin, until = pointers.get(rank).astype(np.int64), pointers.get(rank + 1).astype(np.int64)
        some = np.flatnonzero(begin < until)
        begin, until, want, at = begin[some], until[some], want[some], at[some]
        if not len(some):
            return begin, at
        base = np.where(begin > 0, level.get(np.maximum(begin - 1, 0)), U(0))
        place, equal = level.successor(base + (want >> U(64 - SUCCESSOR_BITS)) + U(1))
        equal &= (place >= begin) & (place < until)
        return place[equal], at[equal]


def train(texts: DataFrame, work: Workspace) -> tuple[str, dict[int, str], dict[int, str], int, dict[str, int]]:
    """Build the model of texts(text) in the shared folder: (root, files of pairs and of words by shard, log2 of the
    number of shards, sums)."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max(-(-size // SHARD_BYTES) - 1, 0).bit_length(), MOST_SHARDS_LOG2)
    rows = texts.select("text").mapInPandas(count_ngrams(bits), "shard int, " + ", ".join(f"{c} binary" for c in ROW))
    root, homes = f"{work.root}/trie", min(bits, HOME_BITS)
    built = work.save(rows.groupBy("shard").applyInPandas(write_pairs(root, homes), "shard int, home int, file string, words binary, counts binary, heads binary, fans binary"), "pairs")
    pairs = {r["shard"]: r["file"] for r in built.where("home < 0").select("shard", "file").collect()}  # one for each shard
    rows = built.where("home >= 0").groupBy("home").applyInPandas(write_words(root), "home int, file string, words long, tokens long, once long, twice long")
    rows = work.save(rows, "words").collect()  # one for each file of words
    work.drop("pairs", "words")
    return root, pairs, {r["home"]: r["file"] for r in rows}, bits, {k: sum(r[k] for r in rows) for k in ("words", "tokens", "once", "twice")}


def score_texts(docs: DataFrame, model: tuple, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id (as string), n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts are their end alone, null ids stay null, repeated rows are scored each. A model of no text
    knows no word and gives every token probability 1. Other columns are not read; an empty table gives an empty result.
    """
    n_all = model[4]["tokens"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, cache = Model(*model), Words()

        def scored(ids, texts):
            return pd.concat([pd.DataFrame({"id": ids}), trie.score(texts)], axis=1).assign(train_tokens=n_all)

        ids, texts, n = [], [], 0
        for batch in batches:
            for i, text in zip(batch["id"], batch["text"], strict=True):
                texts.append(np.array(cache.tokens(text), dtype=U))
                ids.append(i)
                n += len(texts[-1])
                if n >= SCORE_TOKENS:
                    yield scored(ids, texts)
                    ids, texts, n = [], [], 0
        if ids:
            yield scored(ids, texts)

    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInPandas(run, "id string, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.where(id_hash("doc_id") % 7 != 2), Workspace(spark))
    scored = score_texts(docs, model).withColumn("doc_id", F.col("id").cast("long"))
    return scored.select("doc_id", (id_hash("doc_id") % 7 == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
