"""Elias-Fano sequences as numpy arrays that can be mapped from a file, with vectorised queries.

n ascending numbers below u keep ``log2(u / n)`` low bits each in a packed array; the high parts are
written in unary into a bit vector, number i with high part h as a one at bit h + i. Numbers
of ones and zeros before every word of the bit vector make selects a binary search.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

from papyra.llm.blocks import map_file, write_file

ONE, WORD = np.uint64(1), np.uint64(63)
PAIRS, FOURS, NIBBLES, BYTES, TOPS = (np.uint64(x * 0x0101010101010101) for x in (0x55, 0x33, 0x0F, 0x01, 0x80))
LAST, WINDOW = np.uint64(0xFF), np.uint64((1 << 57) - 1)
#: The place of the k-th one in a byte.
SELECT = np.array([([i for i in range(8) if byte >> i & 1] + [0] * 8)[:8] for byte in range(256)], np.int64)


def build(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """The arrays of an ascending sequence of numbers below ``universe``."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    bits = max(0, (universe // max(n, 1)).bit_length() - 1)
    parts = []
    for i in range(0, n if bits else 0, 1 << 16):
        low = values[i : i + (1 << 16), None] >> np.arange(bits, dtype=np.uint64) & ONE
        parts.append(np.packbits(low.astype(np.uint8).ravel(), bitorder="little"))
    low = np.concatenate([*parts, np.zeros(8, np.uint8)])
    at = (values >> np.uint64(bits)) + np.arange(n, dtype=np.uint64)
    marks = np.zeros((n + (universe >> bits) + 2 + 63) // 64 * 64 + 64, np.uint8)  # a word more, so that eight bytes can be read anywhere
    marks[at.astype(np.int64)] = 1
    high = np.packbits(marks, bitorder="little").view(np.uint64)
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))])[:-1]
    return {"shape": np.array([n, bits], np.int64), "low": low, "high": high, "ones": ones.astype(np.uint32), "zeros": (np.arange(len(high)) * 64 - ones).astype(np.uint32)}


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, bits = (int(x) for x in arrays["shape"])
        self.bits, self.mask = np.uint64(bits), np.uint64((1 << bits) - 1)
        low = arrays["low"]
        # every byte offset as the start of a 64-bit number
        self.low = np.ndarray((len(low) - 7,), np.dtype("<u8"), low, strides=(1,))
        self.high, self.ones, self.zeros = arrays["high"], arrays["ones"], arrays["zeros"]
        self.bytes = np.ndarray((self.high.nbytes - 7,), np.dtype("<u8"), self.high, strides=(1,))

    def _select(self, before: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
        """Bit position of the k-th one, or zero if ``flip``: the word by its count before, the byte by
        the sums of its bytes' counts, the bit by a table."""
        at = np.searchsorted(before, k.astype(before.dtype), "right") - 1
        word = self.high[at]
        if flip:
            word = ~word
        rest = (k - before[at]).astype(np.uint64)
        sums = word - ((word >> ONE) & PAIRS)
        sums = (sums & FOURS) + ((sums >> np.uint64(2)) & FOURS)
        sums = ((sums + (sums >> np.uint64(4))) & NIBBLES) * BYTES  # byte i: ones in bytes 0 to i
        byte = np.bitwise_count((((rest * BYTES) | TOPS) - sums) & TOPS).astype(np.uint64)  # bytes whose sum is not above the rest
        shift = byte << np.uint64(3)
        rest -= ((sums << np.uint64(8)) >> shift) & LAST
        place = SELECT[((word >> shift) & LAST).astype(np.intp), rest.astype(np.intp)]
        return (at << 6) + shift.astype(np.int64) + place

    def _next(self, position: np.ndarray, before: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
        """The position of the one (or zero) number k, which is the next after ``position``."""
        bit = position + 1
        window = self.bytes[bit >> 3]
        if flip:
            window = ~window
        window = window >> (bit & 7).astype(np.uint64)
        window &= WINDOW  # what the shift has left for sure
        out = bit + np.bitwise_count(~window & (window - ONE))
        far = np.flatnonzero(window == 0)
        if len(far):
            out[far] = self._select(before, k[far], flip)
        return out

    def lows(self, i: np.ndarray) -> np.ndarray:
        bit = i.astype(np.uint64) * self.bits
        return (self.low[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7))) & self.mask

    def access(self, i: np.ndarray) -> np.ndarray:
        """The numbers at some places."""
        high = (self._select(self.ones, i, False) - i).astype(np.uint64)
        return (high << self.bits) | self.lows(i)

    def ranges(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers at some places and at the places after them."""
        first = self._select(self.ones, i, False)
        second = self._next(first, self.ones, i + 1, False)
        high = lambda at, k: (at - k).astype(np.uint64) << self.bits
        return high(first, i) | self.lows(i), high(second, i + 1) | self.lows(i + 1)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Where some numbers stand, -1 for those that do not: all numbers with the same high part
        lie between two zeros, and there the low parts ascend."""
        out = np.full(len(values), -1, np.int64)
        if not self.n:
            return out
        values = values.astype(np.uint64)
        high, goal = (values >> self.bits).astype(np.int64), values & self.mask
        inside = np.flatnonzero(high < len(self.high) * 64 - self.n - 1)
        h, goal = high[inside], goal[inside]
        start = np.where(h > 0, self._select(self.zeros, np.maximum(h - 1, 0), True), -1)
        hi = self._next(start, self.zeros, h, True) - h
        lo = start - h + 1
        open_ = np.flatnonzero(lo < hi)
        lo, hi, goal, inside = lo[open_], hi[open_], goal[open_], inside[open_]
        # most high parts have one number: look at the first before halving the rest
        first = self.lows(lo)
        there = first == goal
        out[inside[there]] = lo[there]
        more = np.flatnonzero((first < goal) & (lo + 1 < hi))
        lo, hi, goal, inside = lo[more] + 1, hi[more], goal[more], inside[more]
        end, todo = hi.copy(), np.arange(len(lo))
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            less = self.lows(mid) < goal[todo]
            lo[todo] = np.where(less, mid + 1, lo[todo])
            hi[todo] = np.where(less, hi[todo], mid)
            todo = todo[lo[todo] < hi[todo]]
        there = np.flatnonzero(lo < end)
        there = there[self.lows(lo[there]) == goal[there]]
        out[inside[there]] = lo[there]
        return out


def save(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays in one file, each at a multiple of eight bytes, behind a description."""
    header, at = {}, 0
    for name, a in arrays.items():
        header[name] = [at, len(a), a.dtype.str]
        at += -(-a.nbytes // 8) * 8
    text = json.dumps(header).encode()
    text += b" " * (-len(text) % 8)
    parts = [np.array([len(text)], "<i8").tobytes(), text]
    for a in arrays.values():
        parts += [np.ascontiguousarray(a).tobytes(), b"\0" * (-a.nbytes % 8)]
    write_file(uri, parts)


def load(uri: str) -> dict[str, np.ndarray]:
    data = map_file(uri)
    size = int(data[:8].view("<i8")[0])
    header = json.loads(data[8 : 8 + size].tobytes())
    return {name: data[8 + size + at : 8 + size + at + n * np.dtype(kind).itemsize].view(kind) for name, (at, n, kind) in header.items()}


def part(arrays: dict[str, np.ndarray], prefix: str) -> EliasFano:
    return EliasFano({k.removeprefix(prefix): v for k, v in arrays.items() if k.startswith(prefix)})


def named(arrays: dict[str, np.ndarray], prefix: str) -> dict[str, np.ndarray]:
    return {f"{prefix}{k}": v for k, v in arrays.items()}


def opened(uri: str) -> tuple[dict[str, np.ndarray], dict[str, EliasFano]]:
    """A file's arrays and the sequences among them, by prefix."""
    arrays = load(uri)
    return arrays, {k: part(arrays, f"{k}.") for k in {name.split(".")[0] for name in arrays if "." in name}}


cached_open = lru_cache(maxsize=4096)(opened)
