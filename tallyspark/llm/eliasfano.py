"""Elias-Fano sequences and byte-quantised values in one flat file that numpy maps into memory.

A sequence of n ascending integers below u keeps l = log2(u / n) low bits of each value packed, and the high
bits in unary: value i sets bit (value >> l) + i. Counts of ones before each block of words serve select.
All queries take arrays.
"""

from __future__ import annotations

import json

import numpy as np

U = np.uint64
#: Words of the unary part for each count of ones.
BLOCK = 4
#: Position of the rank-th one of each byte.
IN_BYTE = np.argsort(1 - np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little"), axis=1, kind="stable").astype(np.uint8)


def select_in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Position of the rank-th (from 0) one in each word."""
    words, rank, at = words.copy(), rank.astype(np.uint8), np.zeros(len(words), dtype=np.uint8)
    for width in (32, 16, 8):
        ones = np.bitwise_count(words & U((1 << width) - 1))
        up = (rank >= ones).astype(np.uint8)
        rank -= ones * up
        up *= width
        words >>= up
        at += up
    at += IN_BYTE[(words & U(255)).astype(np.intp), rank & 7]
    return at.astype(np.int64)


def to_words(bits: np.ndarray, spare: int = 1) -> np.ndarray:
    packed = np.packbits(bits, bitorder="little")
    return np.pad(packed, (0, -len(packed) % 8 + 8 * spare)).view(np.uint64)


class EliasFano:
    """Parts are plain arrays, so that they can be views of a mapped file."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max((top // max(n, 1)).bit_length() - 1, 0)
        each = np.empty((n, bits), dtype=np.uint8)  # bit by bit, so that no array of n * bits words is made
        for b in range(bits):
            each[:, b] = (values >> U(b)) & U(1)
        low = to_words(each.reshape(-1))
        place = (values >> U(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros((int(place[-1]) if n else 0) + 2, dtype=np.uint8)
        unary[place] = 1
        high = to_words(unary, spare=0)
        high = np.pad(high, (0, -len(high) % BLOCK))
        per_block = np.bitwise_count(high).reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)
        return cls(n, bits, low, high, np.cumsum(per_block) - per_block)

    def select(self, i: np.ndarray, before: np.ndarray, flip: np.uint64) -> np.ndarray:
        """Position of the i-th one of the unary part, its words taken xor flip; before: ones before each block."""
        block = np.searchsorted(before, i, side="right") - 1
        rank, w = i - before[block], block * BLOCK
        for _ in range(BLOCK - 1):
            ones = np.bitwise_count(self.high[w] ^ flip)
            up = rank >= ones
            rank -= ones * up
            w += up
        return 64 * w + select_in_word(self.high[w] ^ flip, rank)

    def select1(self, i: np.ndarray) -> np.ndarray:
        return self.select(i, self.ones, U(0))

    def select0(self, i: np.ndarray) -> np.ndarray:
        return self.select(i, 64 * BLOCK * np.arange(len(self.ones), dtype=np.int64) - self.ones, ~U(0))

    def low_at(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), dtype=np.uint64)
        p = i * self.low_bits
        w, off = p >> 6, (p & 63).astype(np.uint64)
        both = (self.low[w] >> off) | ((self.low[w + 1] << (U(63) - off)) << U(1))
        return both & U((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.select1(i) - i).astype(np.uint64) << U(self.low_bits)) | self.low_at(i)

    def successor(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first element >= value or n, whether it is equal)."""
        high = np.minimum(values >> U(self.low_bits), U(1 << 62)).astype(np.int64)
        last = 64 * len(self.high) - self.n - 1  # zeros that can be asked for
        lo = np.where(high > 0, self.select0(np.clip(high - 1, 0, last)) - np.clip(high - 1, 0, last), 0)
        hi = np.minimum(self.select0(np.clip(high, 0, last)) - np.clip(high, 0, last), self.n)
        lo = np.where(high > last, self.n, np.minimum(lo, self.n))
        hi = np.maximum(np.where(high > last, self.n, hi), lo)
        end, want = hi.copy(), values & U((1 << self.low_bits) - 1)
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self.low_at(mid) < want[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        equal = np.zeros(len(values), dtype=bool)
        inside = np.flatnonzero(lo < end)
        equal[inside] = self.low_at(lo[inside]) == want[inside]
        return lo, equal

    def parts(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.{k}": v for k, v in (("shape", np.array([self.n, self.low_bits], dtype=np.int64)), ("low", self.low), ("high", self.high), ("ones", self.ones))}

    @classmethod
    def of(cls, parts: dict[str, np.ndarray], name: str) -> EliasFano:
        n, bits = parts[f"{name}.shape"].tolist()
        return cls(n, bits, *[parts[f"{name}.{k}"] for k in ("low", "high", "ones")])


def quantise(values: np.ndarray, levels: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(code of a byte for each value, values of the codes): half the levels hold equally many values, half lie evenly."""
    if not len(values):
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.float64)
    half = levels // 2
    book = np.unique(np.concatenate([np.quantile(values, (np.arange(half) + 0.5) / half), np.linspace(values.min(), values.max(), levels - half)]))
    return np.searchsorted((book[1:] + book[:-1]) / 2, values).astype(np.uint8), book


def to_bytes(parts: dict[str, np.ndarray]) -> bytes:
    """Header of JSON, then the arrays, each at a multiple of 8 bytes."""
    layout, at, body = {}, 0, []
    for name, a in parts.items():
        raw = np.ascontiguousarray(a).tobytes()
        layout[name] = (at, str(a.dtype), len(a))
        body.append(raw + b"\0" * (-len(raw) % 8))
        at += len(body[-1])
    head = json.dumps(layout).encode()
    head += b" " * (-len(head) % 8)
    return len(head).to_bytes(8, "little") + head + b"".join(body)


def from_buffer(buffer: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays as views of a byte array, such as a memory map."""
    size = int.from_bytes(buffer[:8].tobytes(), "little")
    layout = json.loads(buffer[8 : 8 + size].tobytes())
    return {k: np.frombuffer(buffer, dtype=d, count=n, offset=8 + size + at) for k, (at, d, n) in layout.items()}
