"""SentencePiece encoding by vectorised merge rounds, and decoding from the same tables.

The texts of a batch are one flat array of symbols, cut into words wherever no piece of the vocabulary holds the two
characters side by side: no merge crosses such a place. In a round every word finds its best pair (a segmented
maximum of the scores) and merges all its occurrences at once, leftmost first; words without a pair leave the array,
which is compacted. The library merges one pair at a time, best score first and leftmost among equals. Merging
several at once gives the same as long as no pair made by them is as good as the pair that made it; a word where
that happens merges its leftmost occurrence only. So a round is exact, whatever the scores.

A word of more than LONG symbols would take a round for each of its distinct pairs; such words (a cut is nearly
everywhere) go through a heap instead, which is exact as well and takes n log n steps.

Characters that are no piece become their UTF-8 bytes. Only models that do not change texts but for the space
mark are taken: `Model.load` compares with the library's own normaliser and refuses others.

The tables come from the model file on the driver (tens of thousands of entries, whatever the data) and travel with
the function, so executors need neither the file nor the library.

Null texts are empty and give no ids; repeated rows give repeated rows; a null doc_id is kept; other columns are
ignored; an empty table gives an empty result. Texts are processed whole; a text is taken in blocks of whole words.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ._work import table

MODEL = "piece_bpe_32k.model"
MARK, SPACE = 0x2581, 0x20
#: Symbols of a word above which a heap takes the place of rounds, and characters that are encoded at a time.
LONG, BLOCK = 128, 1 << 20
NONE = np.int64(-1)
MIX = np.uint64(0x9E3779B97F4A7C15)
PROBES = ((" a", "▁ a"), ("a  b\tc\n", "a  b\tc\n"), ("ﬁ Ⅳ é", "ﬁ Ⅳ é"))


class Model(NamedTuple):
    """pieces: bytes of each id's text; kinds: 0 text, 1 byte, 2 nothing (control), 3 unknown. Symbols are ids of pieces, and
    beyond them n + code point. Tables of pairs and of characters that meet inside a piece are open hash tables."""

    n: int
    pieces: list[bytes]
    kinds: np.ndarray
    chars: np.ndarray  # symbol of each code point
    byte_ids: np.ndarray
    meets: np.ndarray  # hash table of character pairs
    pairs: np.ndarray  # hash table of symbol pairs
    made: np.ndarray  # the piece of a pair
    order: np.ndarray  # rank of the score of each piece; equal scores share a rank
    dummy: bool
    marks_begin: bool  # no piece holds the space mark after another character

    @staticmethod
    def load(path: str) -> Model:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = len(sp)
        texts = [sp.id_to_piece(i) for i in range(n)]
        kinds = np.array([1 if sp.is_byte(i) else 2 if sp.is_control(i) else 3 if sp.is_unknown(i) else 0 for i in range(n)], dtype=np.int8)
        byte_ids = np.flatnonzero(kinds == 1)
        if len(byte_ids) != 256 or any(sp.is_unused(i) for i in range(n)):
            raise ValueError("the model has no byte pieces, or unused ones")
        dummy = sp.normalize("a") != "a"
        if any(sp.normalize(x) != ("▁" if dummy else "") + x.replace(" ", "▁") for x, _ in PROBES):
            raise ValueError("the model changes texts before it cuts them")
        ids = {texts[i]: i for i in np.flatnonzero(kinds == 0).tolist()}
        scores = np.array([sp.get_score(i) for i in range(n)])
        order = np.searchsorted(np.unique(-scores), -scores)
        symbol = lambda x: ids.get(x, n + ord(x) if len(x) == 1 else None)
        made, meets = {}, set()
        for x, i in ids.items():
            meets |= {ord(a) << 21 | ord(b) for a, b in zip(x, x[1:])}  # noqa: B905  neighbours
            for k in range(1, len(x)):
                a, b = symbol(x[:k]), symbol(x[k:])
                if a is not None and b is not None:
                    made[a << 32 | b] = i
        chars = np.arange(n, n + 0x110000, dtype=np.int32)
        for x, i in ids.items():
            if len(x) == 1:
                chars[ord(x)] = i
        pairs = hash_table(np.array(list(made), dtype=np.int64))
        pieces = np.full(len(pairs), -1, dtype=np.int64)
        pieces[find(pairs, np.array(list(made), dtype=np.int64))] = list(made.values())
        shown = [b"" if kinds[i] == 2 else " ⁇ ".encode() if kinds[i] == 3 else bytes([int(x[1:-1], 16)]) if kinds[i] == 1 else x.replace("▁", " ").encode() for i, x in enumerate(texts)]
        byte_of = np.zeros(256, dtype=np.int64)
        byte_of[[int(texts[i][1:-1], 16) for i in byte_ids]] = byte_ids
        return Model(n, shown, kinds, chars, byte_of, hash_table(np.array(sorted(meets), dtype=np.int64)), pairs, pieces, order, dummy, not any(key & ((1 << 21) - 1) == MARK and key >> 21 != MARK for key in meets))


def slot_of(keys: np.ndarray, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((keys.astype(np.uint64) * MIX) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)


def hash_table(keys: np.ndarray) -> np.ndarray:
    """Slots of a power of two, a quarter full at most; a key lies in the first free slot from its own on."""
    size = 1 << max(int(len(keys) * 4).bit_length(), 4)
    slots = np.full(size, NONE)
    for key, at in zip(keys.tolist(), slot_of(keys, size).tolist(), strict=True):
        while slots[at] >= 0:
            at = (at + 1) % size
        slots[at] = key
    return slots


def find(slots: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The slot of each key, -1 where it is not there."""
    at = slot_of(keys, len(slots))
    there = slots[at]
    out = np.where(there == keys, at, NONE)
    open_ = np.flatnonzero((there != keys) & (there >= 0))
    while len(open_):
        at[open_] = (at[open_] + 1) & (len(slots) - 1)
        there = slots[at[open_]]
        found = there == keys[open_]
        out[open_[found]] = at[open_[found]]
        open_ = open_[~found & (there >= 0)]
    return out


FAR = np.int64(1) << 40  # a rank beyond all


def lookup(m: Model, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank, piece) of the pairs of symbols; FAR where they make no piece."""
    slot = find(m.pairs, left << 32 | right)
    piece = np.where(slot >= 0, m.made[slot], NONE)
    return np.where(slot >= 0, m.order[piece], FAR), piece


def word_starts(m: Model, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Marks the starts of words: at space marks where that is enough, and inside long words wherever no piece holds
    both characters."""
    first = np.zeros(len(points), dtype=bool)
    first[0] = True
    first[ends[:-1]] = True
    if m.marks_begin:
        mark = points == MARK
        first[1:] |= mark[1:] & ~mark[:-1]
    start = np.flatnonzero(first)
    length = np.diff(np.append(start, len(points)))
    inner = np.flatnonzero(np.repeat(length > LONG, length) & ~first)
    first[inner[find(m.meets, points[inner - 1] << 21 | points[inner]) < 0]] = True
    return first


def encode_words(m: Model, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Merged symbols (see merge) of a block. Words that repeat are merged once: words of equal length and sum of mixed
    characters are compared with the first of them."""
    first = word_starts(m, points, ends)
    start = np.flatnonzero(first)
    length = np.diff(np.append(start, len(points)))
    inside = np.arange(len(points)) - np.repeat(start, length)
    with np.errstate(over="ignore"):
        mixed = (points.astype(np.uint64) + (inside.astype(np.uint64) << np.uint64(32))) * MIX
        mixed ^= mixed >> np.uint64(29)
        key = np.add.reduceat(mixed * MIX, start) * MIX + length.astype(np.uint64)
    _, own, of = np.unique(key, return_index=True, return_inverse=True)
    chosen = own[of]
    longer = np.minimum(length, length[chosen])
    at = np.repeat(start, longer) + (part := np.arange(longer.sum()) - np.repeat(np.cumsum(longer) - longer, longer))
    other = np.repeat(start[chosen], longer) + part
    same = (length == length[chosen]) & (np.bincount(np.repeat(np.arange(len(start)), longer)[points[at] != points[other]], minlength=len(start)) == 0)
    chosen = np.where(same, chosen, np.arange(len(start)))
    alone = chosen == np.arange(len(start))
    keep = np.repeat(alone, length)
    merged = merge(m, m.chars[points[keep]].astype(np.int64), first[keep])
    begin = np.zeros(len(start), dtype=np.int64)  # of each chosen word among the kept ones
    begin[alone] = np.cumsum(length[alone]) - length[alone]
    return merged[np.repeat(begin[chosen], length) + inside]


def merge_long(m: Model, symbols: list[int]) -> list[int]:
    """One long word through a heap of (rank, place)."""
    after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
    heap: list[tuple[int, int, int, int, int]] = []

    def push(lefts: list[int]) -> None:
        rights = [after[i] for i in lefts]
        rank, piece = lookup(m, np.array([symbols[i] for i in lefts], dtype=np.int64), np.array([symbols[i] for i in rights], dtype=np.int64))
        for i, j, r, p in zip(lefts, rights, rank.tolist(), piece.tolist(), strict=True):
            if p >= 0:
                heapq.heappush(heap, (r, i, symbols[i], symbols[j], p))

    push(list(range(len(symbols) - 1)))
    while heap:
        _, i, a, b, piece = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != a or j == len(symbols) or symbols[j] != b:
            continue
        symbols[i], symbols[j], after[i] = piece, -1, after[j]
        if after[i] < len(symbols):
            before[after[i]] = i
        push([k for k in (before[i], i) if k >= 0 and after[k] < len(symbols)])
    return [s for s in symbols if s >= 0]


def merge(m: Model, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Symbols after all merges, in place of those they came from (-1 elsewhere). first: marks the starts of words."""
    out = np.full(len(symbols), NONE)
    start = np.flatnonzero(first)
    length = np.diff(np.append(start, len(symbols)))
    for s, n in zip(start[length > LONG].tolist(), length[length > LONG].tolist(), strict=True):
        done = merge_long(m, symbols[s : s + n].tolist())
        out[s : s + len(done)] = done
    keep = np.repeat(length <= LONG, length)
    sym, head, place = symbols[keep], first[keep], np.flatnonzero(keep)
    rank, piece = np.full(len(sym), FAR), np.full(len(sym), NONE)
    inner = np.flatnonzero(~head[1:])  # the left ends of pairs within words
    rank[inner], piece[inner] = lookup(m, sym[inner], sym[inner + 1])
    while len(sym):
        start = np.flatnonzero(head)
        length = np.diff(np.append(start, len(sym)))
        best = np.minimum.reduceat(rank, start)
        alive = np.repeat(best < FAR, length)
        if not alive.all():  # words that are done leave
            out[place[~alive]] = sym[~alive]
            sym, head, place, rank, piece = sym[alive], head[alive], place[alive], rank[alive], piece[alive]
            length, best = length[best < FAR], best[best < FAR]
            if not len(sym):
                break
        word = np.repeat(np.arange(len(length)), length)
        at = np.flatnonzero(rank == best[word])
        # of occurrences that overlap, every other one from the left
        run = np.append(True, np.diff(at) != 1)
        at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))) % 2 == 0]
        several = np.flatnonzero(np.append(False, word[at[1:]] == word[at[:-1]]))
        if len(several):
            at = leftmost_where_needed(m, sym, head, word, at, piece, rank, several)
        sym[at] = piece[at]
        gone = at + 1
        keep = np.ones(len(sym), dtype=bool)
        keep[gone] = False
        moved = at - np.arange(len(at))  # where the merged symbols are now
        sym, head, place, rank, piece = sym[keep], head[keep], place[keep], rank[keep], piece[keep]
        left = moved[~head[moved]] - 1
        anew = np.concatenate([moved, left]) if len(left) else moved
        last = np.append(head[1:], True)
        rank[anew], piece[anew] = FAR, NONE
        anew = anew[~last[anew]]
        rank[anew], piece[anew] = lookup(m, sym[anew], sym[anew + 1])
    return out


def leftmost_where_needed(m: Model, sym: np.ndarray, head: np.ndarray, word: np.ndarray, at: np.ndarray, piece: np.ndarray, rank: np.ndarray, several: np.ndarray) -> np.ndarray:
    """at without all but the first occurrence in words where a merge would make a pair as good as its own."""
    crowded = np.zeros(int(word[-1]) + 1, dtype=bool)
    crowded[word[at[several]]] = True
    mine = at[crowded[word[at]]]
    made = np.full(len(sym) + 1, NONE)
    made[mine] = piece[mine]
    worst = np.zeros(len(crowded), dtype=bool)
    back = mine[~head[mine]]  # with what is before: the neighbour's own merge if that ends here
    before = np.where((back >= 2) & (made[back - 2] >= 0), made[back - 2], sym[back - 1])
    worst[word[back[lookup(m, before, piece[back])[0] <= rank[back]]]] = True
    last = np.append(head[1:], True)
    ahead = mine[~last[mine + 1]]
    worst[word[ahead[lookup(m, piece[ahead], sym[ahead + 2])[0] <= rank[ahead]]]] = True
    again = np.append(False, word[at[1:]] == word[at[:-1]])
    return at[~(again & worst[word[at]])]


def to_ids(m: Model, merged: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids of each text) from merged symbols; characters that are no piece become bytes."""
    here = np.flatnonzero(merged >= 0)
    sym = merged[here]
    text = np.searchsorted(ends, here, side="right")
    rare = sym >= m.n
    if rare.any():
        points = sym[rare] - m.n
        width = np.ones(len(sym), dtype=np.int64)
        width[rare] = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        ids = np.repeat(sym, width)
        spelt = np.frombuffer("".join(map(chr, points.tolist())).encode(), dtype=np.uint8)
        ids[np.repeat(rare, width)] = m.byte_ids[spelt]
        text = np.repeat(text, width)
    else:
        ids = sym
    return ids, np.bincount(text, minlength=len(ends))


def encode(m: Model, texts: list[str]) -> list[np.ndarray]:
    """The ids of each text. Blocks of whole words bound the memory, whatever the length of a text."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    block: list[np.ndarray] = []
    owners: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal block, owners, held
        if not block:
            return
        points = np.concatenate(block)
        ends = np.cumsum([len(b) for b in block])
        ids, counts = to_ids(m, encode_words(m, points, ends), ends)
        for owner, part in zip(owners, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            out[owner].append(part)
        block, owners, held = [], [], 0

    for k, text in enumerate(texts):
        if not text:
            continue
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        points[points == SPACE] = MARK
        if m.dummy:
            points = np.append(np.int64(MARK), points)
        at = 0
        while at < len(points):
            to = min(at + BLOCK, len(points))
            if to < len(points):  # back to the last place between words, or on to the next
                cut = find(m.meets, points[at : to - 1] << 21 | points[at + 1 : to]) < 0
                if cut.any():
                    to = at + int(np.flatnonzero(cut)[-1]) + 1
                else:
                    rest = np.flatnonzero(find(m.meets, points[to - 1 : -1] << 21 | points[to:]) < 0)
                    to = to + int(rest[0]) if len(rest) else len(points)
            block.append(points[at:to])
            owners.append(k)
            held += to - at
            at = to
            if held >= BLOCK:
                flush()
    flush()
    return [np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64) for parts in out]


def _byte_by_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1  # type: ignore[attr-defined]


def decode(m: Model, ids: np.ndarray) -> bytes:
    """UTF-8 of the text of ids: spaces for their mark, but not for the one that begins the text; bytes that are no
    character become one replacement character each."""
    kinds = m.kinds[ids]
    parts = list(map(m.pieces.__getitem__, ids.tolist()))
    said = np.flatnonzero(kinds != 2)
    if m.dummy and len(said) and kinds[said[0]] == 0 and parts[said[0]].startswith(b" "):
        parts[said[0]] = parts[said[0]][1:]
    control = np.flatnonzero(kinds == 2)
    if not len(control):
        return readable(b"".join(parts))
    edges = [0, *(control + 1).tolist(), len(parts)]  # bytes before and after such an id are no character together
    return b"".join(readable(b"".join(parts[lo:hi])) for lo, hi in zip(edges[:-1], edges[1:], strict=True))


def readable(text: bytes) -> bytes:
    try:
        text.decode()
    except UnicodeDecodeError:  # not from encode()
        codecs.register_error("tallyspark-bytes", _byte_by_byte)
        return text.decode("utf-8", errors="tallyspark-bytes").encode()
    return text


def encode_documents(docs: DataFrame, *, model: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ids array<int>, decoded. model: path of a model file on the driver."""
    m = Model.load(model)  # large closures travel as a broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids = encode(m, texts_of(part))
            decoded = pa.array([decode(m, i) for i in ids], pa.binary()).cast(pa.string())
            offsets = np.append(0, np.cumsum([len(i) for i in ids])).astype(np.int32)
            flat = np.concatenate([*ids, np.zeros(0, dtype=np.int64)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), decoded], ["doc_id", "ids", "decoded"])

    kind = StructType([docs.schema["doc_id"], StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())])
    return docs.select("doc_id", "text").mapInArrow(run, kind)


def slices(batches: Iterator[pa.RecordBatch], most: int = 8 * BLOCK) -> Iterator[pa.RecordBatch]:
    """The batches in parts of some bytes of text; a row stays whole."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes) // most
        edges = np.append(np.flatnonzero(np.append(True, np.diff(part) != 0)), batch.num_rows) if batch.num_rows else []
        for lo, hi in zip(edges[:-1], edges[1:]):  # noqa: B905
            yield batch.slice(int(lo), int(hi - lo))


def texts_of(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def digest_documents(docs: DataFrame, *, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document, without moving ids out of the task."""
    m = Model.load(model)  # large closures travel as a broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = [str(i) for i in range(m.n)]
        for part in slices(batches):
            ids = encode(m, texts_of(part))
            spelt = [hashlib.sha256(",".join(map(numbers.__getitem__, i.tolist())).encode()).hexdigest() for i in ids]
            said = [hashlib.sha256(decode(m, i)).hexdigest() for i in ids]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(i) for i in ids], pa.int64()), pa.array(spelt, pa.string()), pa.array(said, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = StructType([docs.schema["doc_id"], StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])
    return docs.select("doc_id", "text").mapInArrow(run, kind)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_documents(table(spark, sf_dir, "documents"), model=public_tokenizers.path(MODEL))
