"""A trie of n-grams in Elias-Fano code: levels of integers and quantised probabilities that are mapped, not parsed.

The trie has a word, the words before it, and what follows: a node for each word v that is a context, below it v's
successors w and v's predecessors u, and below a predecessor the successors of the pair (u, v). A level is one increasing
sequence; pointers, increasing too, say where a word's children begin. What follows a pair also follows its word, so a
successor of a pair is named by its rank among the word's successors, and a pair by its rank among the word's predecessors
(the context-relative names of Pibiri and Venturini, 2017): these are small numbers where words are large ones. A lookup is
a successor search in a level: the high bits lead to a bucket of about one number, the low bits are compared.

Probabilities interpolate by absolute discounting (Ney, Essen and Kneser, 1994): of a context's counts each successor
gives D away, and what is given away weighs the shorter context. They are kept as 8 bits of their logarithms.
"""

from __future__ import annotations

import json
import mmap
from typing import BinaryIO

import numpy as np

#: What a count gives away; steps of a tenfold in quantised probabilities.
DISCOUNT, STEPS = 0.75, 28
#: Quantised probabilities: 0 for none, then 1, 10^(-1/STEPS) and so on.
VALUES = np.concatenate([[0.0], 10.0 ** (-np.arange(255) / STEPS)])


def quantise(p: np.ndarray) -> np.ndarray:
    """Codes of probabilities above 0, to the nearest step; what is below the last step has it."""
    return (np.clip(np.rint(-np.log10(p) * STEPS), 0, 254) + 1).astype(np.uint8)


def _pack(x: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of numbers, end to end in 64-bit words, with a word to spare."""
    out, shift = [], np.arange(bits, dtype=np.uint64)
    for lo in range(0, len(x) * (bits > 0), 1 << 16):
        part = (x[lo : lo + (1 << 16), None].astype(np.uint64) >> shift) & np.uint64(1)
        raw = np.packbits(part.astype(np.uint8).reshape(-1), bitorder="little")
        out.append(np.pad(raw, (0, -len(raw) % 8)).view(np.uint64))
    return np.concatenate([*out, np.zeros(2, np.uint64)])


def _nth(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The place of the r-th one (from 0) of 64-bit words."""
    at = np.zeros(len(x), np.int64)
    for w in (32, 16, 8, 4, 2, 1):
        c = np.bitwise_count(x & np.uint64((1 << w) - 1)).astype(np.int64)
        go = r >= c
        r = np.where(go, r - c, r)
        x = np.where(go, x >> np.uint64(w), x)
        at += go * w
    return at


class EliasFano:
    """A non-decreasing sequence of numbers from 0 to below ``universe``: low bits end to end, high bits in unary."""

    @staticmethod
    def encode(x: np.ndarray, universe: int) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(n, universe, low bits), and the words of both parts."""
        n = len(x)
        bits = max(0, (universe // max(1, n)).bit_length() - 1)
        flags = np.zeros(-(-(n + (universe >> bits) + 2) // 64) * 64, np.uint8)
        flags[(x >> bits).astype(np.int64) + np.arange(n)] = 1
        return [n, universe, bits], _pack(x, bits), np.packbits(flags, bitorder="little").view(np.uint64)

    def __init__(self, head: list[int], low: np.ndarray, high: np.ndarray):
        (self.n, self.universe, self.bits), self.low, self.high = head, low, high
        ones = np.cumsum(np.bitwise_count(high), dtype=np.int64)
        self.ones = np.concatenate([[0], ones[:-1]])  # before each word
        self._ends: np.ndarray | None = None

    def _buckets(self) -> np.ndarray:
        """Before each bucket of high bits and after the last: how many numbers there are. Made from the mapped bits at the first search."""
        if self._ends is None:
            zeros = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little") == 0)
            self._ends = np.concatenate([[0], zeros - np.arange(len(zeros))]).astype(np.uint32 if self.n < 1 << 32 else np.int64)
        return self._ends

    def _one(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, k, side="right") - 1
        return word * 64 + _nth(self.high[word], k - self.ones[word])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.int64)
        place = i * self.bits
        word, shift = place >> 6, (place & 63).view(np.uint64)
        x = self.low[word] >> shift
        x |= self.low[word + 1] << np.uint64(1) << (np.uint64(63) - shift)  # in two steps, as a shift by 64 isn't one
        x &= np.uint64((1 << self.bits) - 1)
        return x.view(np.int64)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places."""
        i = np.asarray(i, np.int64)
        return ((self._one(i) - i) << self.bits) | self._low(i)

    def find(self, y: np.ndarray) -> np.ndarray:
        """The place of each number, -1 where it isn't in the sequence."""
        y = np.asarray(y, np.int64)
        out = np.full(len(y), -1, np.int64)
        ask = np.flatnonzero((y >= 0) & (y < self.universe)) if self.n else np.zeros(0, np.int64)
        if not len(ask):
            return out
        y = y[ask]
        high, low = y >> self.bits, y & ((1 << self.bits) - 1)
        ends = self._buckets()
        lo, hi = ends[high].astype(np.int64), ends[high + 1].astype(np.int64)
        some = np.flatnonzero(lo < hi)
        ask, lo, hi, low = ask[some], lo[some], hi[some], low[some]
        end = hi
        at, l, h, t = np.arange(len(ask)), lo, hi, low
        while len(at):  # the first of the bucket that isn't less
            mid = (l + h) >> 1
            less = self._low(mid) < t
            l, h = np.where(less, mid + 1, l), np.where(less, h, mid)
            done = l >= h
            lo[at[done]] = l[done]
            left = ~done
            at, l, h, t = at[left], l[left], h[left], t[left]
        some = np.flatnonzero(lo < end)
        some = some[self._low(lo[some]) == low[some]]
        out[ask[some]] = lo[some]
        return out


SEQUENCES, CODES = ("words", "next_ptr", "before_ptr", "base", "next", "before", "triples"), ("next_p", "word_rest", "before_rest", "triple_p")


def spread(x: np.ndarray, bits: int) -> np.ndarray:
    """Numbers below 2^bits in another order, which leaves no part of a level crowded where frequent words have small numbers."""
    return (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) & np.uint64((1 << bits) - 1)).astype(np.int64)


class Trie:
    """Levels over one mapped buffer. ``probabilities`` answers for many contexts at once."""

    @staticmethod
    def build(v: np.ndarray, u: np.ndarray, w: np.ndarray, count: np.ndarray) -> bytes:
        """The levels of triples (u before v before w) with counts above 0, in any order; counts of equal ones add up."""
        names = int(max(u.max(initial=0), w.max(initial=0))).bit_length()
        u, w, most = spread(u, names), spread(w, names), 1 << names
        if int(v.max(initial=0)).bit_length() + 2 * names < 63:
            order = np.argsort(v << 2 * names | u << names | w)
        else:
            order = np.lexsort((w, u, v))
        v, u, w, count = v[order], u[order], w[order], count[order]
        first = np.flatnonzero((np.diff(v, prepend=-1) != 0) | (np.diff(u, prepend=-1) != 0) | (np.diff(w, prepend=-1) != 0))
        v, u, w, count = v[first], u[first], w[first], np.add.reduceat(count, first) if len(first) else count
        n = len(v)
        first = np.flatnonzero(np.diff(v, prepend=-1))
        words = v[first]
        at = np.repeat(np.arange(len(words)), np.diff(np.append(first, n)))
        pair, back, pairs = np.unique(at * most + w, return_inverse=True, return_counts=True)
        back = back.reshape(-1)
        both = np.bincount(back, weights=count, minlength=len(pair))
        said = np.bincount(at, weights=count, minlength=len(words))
        owner = pair // most
        kinds = np.bincount(owner, minlength=len(words))
        next_ptr = np.concatenate([[0], np.cumsum(kinds)])
        run = np.flatnonzero(np.diff(at * most + u, prepend=-1))
        of = np.repeat(np.arange(len(run)), np.diff(np.append(run, n)))
        before = (at * most + u)[run]
        before_n = np.bincount(at[run], minlength=len(words))
        before_ptr = np.concatenate([[0], np.cumsum(before_n)])
        base = np.concatenate([[0], np.cumsum(before_n * kinds)])
        triples = base[at] + (of - before_ptr[at]) * kinds[at] + back - next_ptr[at]
        total = np.bincount(of, weights=count, minlength=len(run))
        types = np.bincount(of, minlength=len(run))
        codes = [quantise((both - DISCOUNT) / said[owner]) if n else np.zeros(0, np.uint8), quantise(DISCOUNT * kinds / said) if n else np.zeros(0, np.uint8)]
        codes += [quantise(DISCOUNT * types / total) if n else np.zeros(0, np.uint8), quantise((count - DISCOUNT) / total[of]) if n else np.zeros(0, np.uint8)]
        sequences = (
            (words, int(words.max(initial=0)) + 1), (next_ptr, len(pair) + 1), (before_ptr, len(run) + 1), (base, int(base[-1]) + 1),
            (pair, len(words) * most + 1), (before, len(words) * most + 1), (triples, int(base[-1]) + 1),
        )
        head, body, size = {"names": names}, [], 0
        for name, (x, universe) in zip(SEQUENCES, sequences):
            numbers, low, high = EliasFano.encode(x, universe)
            head[name] = [numbers, size, len(low), size + low.nbytes, len(high)]
            body += [low.tobytes(), high.tobytes()]
            size += low.nbytes + high.nbytes
        for name, x in zip(CODES, codes):
            head[name] = [size, len(x)]
            body.append(x.tobytes() + bytes(-len(x) % 8))
            size += len(body[-1])
        told = json.dumps(head).encode()
        told += b" " * (-len(told) % 8)
        return b"".join([len(told).to_bytes(8, "little"), told, *body])

    def __init__(self, buffer):
        told = int.from_bytes(buffer[:8], "little")
        head, start = json.loads(bytes(buffer[8 : 8 + told])), 8 + told
        view = lambda kind, at, n: np.frombuffer(buffer, kind, n, start + at)
        for name in SEQUENCES:
            numbers, low, n_low, high, n_high = head[name]
            setattr(self, name, EliasFano(numbers, view(np.uint64, low, n_low), view(np.uint64, high, n_high)))
        for name in CODES:
            setattr(self, name, view(np.uint8, *head[name]))
        self.names = head["names"]

    @classmethod
    def open(cls, file: BinaryIO) -> Trie:
        """The trie of a file's levels, mapped."""
        return cls(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))

    @classmethod
    def mapped(cls, raw: bytes) -> Trie:
        """The trie of levels in memory of its own, outside the heap, which goes with the trie."""
        where = mmap.mmap(-1, len(raw))
        where.write(raw)
        return cls(where)

    def probabilities(self, v: np.ndarray, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes of (w's share after u v, what u v leaves, w's share after v, what v leaves); a context that isn't there leaves all."""
        n, most = len(v), 1 << self.names
        share3, rest3, share2, rest2 = (np.full(n, x, np.uint8) for x in (0, 1, 0, 1))
        if not n or not self.words.n:
            return share3, rest3, share2, rest2
        run = np.flatnonzero(np.diff(v, prepend=-1))  # requests in the order of v repeat it
        word = self.words.find(v[run])
        there = np.maximum(word, 0)
        begin, end, ahead, base = self.next_ptr[there], self.next_ptr[there + 1], self.before_ptr[there], self.base[there]
        of = np.repeat(np.arange(len(run)), np.diff(np.append(run, n)))
        known = np.flatnonzero(word[of] >= 0)
        of, u, w = of[known], *(np.where(x < most, spread(x, self.names), -1) for x in (u[known], w[known]))
        rest2[known] = self.word_rest[word[of]]
        after = self.next.find(np.where(w >= 0, word[of] * most + w, -1))
        share2[known] = np.where(after >= 0, self.next_p[np.maximum(after, 0)] if len(self.next_p) else 0, 0)
        change = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(u, prepend=-1) != 0))
        pair = self.before.find(np.where(u[change] >= 0, word[of[change]] * most + u[change], -1))
        pair = np.repeat(pair, np.diff(np.append(change, len(u))))
        seen = np.flatnonzero(pair >= 0)
        rest3[known[seen]] = self.before_rest[pair[seen]]
        both = seen[after[seen] >= 0]
        i = of[both]
        triple = self.triples.find(base[i] + (pair[both] - ahead[i]) * (end - begin)[i] + after[both] - begin[i])
        share3[known[both]] = np.where(triple >= 0, self.triple_p[np.maximum(triple, 0)], 0)
        return share3, rest3, share2, rest2
