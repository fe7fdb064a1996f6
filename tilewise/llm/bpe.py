"""Byte-level BPE by a transducer that is built while it runs.

A rank file's merges are compiled into a deterministic transducer over bytes whose states appear when a text first
needs them. It rests on a property of BPE: the tokens of a string are the tokens of a prefix and one last token, which
is the only vocabulary entry that ends the string and that no merge would join or split across the border with the
token before it. So a state is the token before the oldest undecided border and the bytes read since, with the last
token of each of their lengths; reading a byte finds the last token of one more. ``Packed`` runs many pieces of up to
``LOOK`` bytes at once: states of a level are rows of arrays, and a level's states are made together. ``Transducer``
takes longer pieces one by one and emits, whenever ``LOOK`` bytes or more are undecided, the tokens that every
continuation must share, which bounds the lookahead.

A text is cut into chunks that the pattern never matches across (between a character that is no white space and a
space, for patterns known to allow it; else its matches), and a table has the tokens of the chunks met last; a text is
put together from it. Tables are of bounded size and are emptied when full,
and at the end of a task, so that they don't stand beside what comes next; that changes no result.

Decoding maps ids to bytes and passes them through an incremental UTF-8 state machine, which holds back an incomplete
character until its rest arrives and turns bytes that cannot be UTF-8 into U+FFFD.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewise.llm import scratch
from tilewise.llm.memory import CACHES, release

#: Entries that a table of states, of borders and of chunks holds before it is emptied. Longer chunks aren't kept.
STATES, BORDERS, CHUNKS, KEPT_CHUNK = 50_000, 100_000, 250_000, 64
#: Undecided bytes from which a state looks for what is certain.
LOOK = 24
#: Chunks (or characters) of a long text that are held at once; rows and characters whose tokens are held at once.
BLOCK, SLICE, CHARS = 1 << 18, 1024, 1 << 21
#: Fixed value: the pattern of the first byte-level BPE vocabularies. It has no look-behind, and none of its matches goes on
#: from a character that is no white space to a space.
SPACED = {r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"}
_CHUNK = re.compile(r"\s*\S+(?:[^\S ]\s*\S*)*|\s+")


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: lines of a base64 token, a space, its rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class Transducer:
    """Tokens of pieces, as the merges by rank would give them."""

    def __init__(self, ranks: dict[bytes, int], room: float = 1.0):
        self.room = room
        self.ranks, self.tokens = ranks, {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.opens = {t[:i] for t in ranks for i in range(1, len(t))}  # what a longer token can still grow from
        #: Of two tokens that are a third when joined, its rank.
        self.joined = {ranks[t[:i]] << 20 | ranks[t[i:]]: v for t, v in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.empty()

    def empty(self) -> None:
        """Forget all states and borders."""
        self.border: dict[int, bool] = {}
        self.next: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.number: dict[tuple[int, bytes], int] = {}
        self.states: list[tuple[int, bytes, tuple[int, ...]]] = []
        self._state(-1, b"", ())

    def merge(self, piece: bytes) -> list[int]:
        """The definition: join the neighbours of least rank, leftmost first, until none can be joined."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def made_of(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge is the token's last; None for a byte."""
        if token not in self.halves:
            text = self.tokens[token]
            pair = None
            if len(text) > 1:
                parts = [text[i : i + 1] for i in range(len(text))]
                while len(parts) > 2:
                    _, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                    parts[at : at + 2] = [parts[at] + parts[at + 1]]
                pair = self.ranks[parts[0]], self.ranks[parts[1]]
            self.halves[token] = pair
        return self.halves[token]

    def apart(self, a: int, b: int) -> bool:
        """Whether a then b stay two tokens: at no time would a merge across their border have come first.

        Both sides are taken apart from the last merge to the first. While the neighbours at the border are x and y,
        the next merge to happen on either side has rank ``first``; a merge of x with y below that would have won.
        On equal rank the left one wins, as the leftmost pair is joined first.
        """
        halves, joined = self.halves, self.joined
        x, y, first, out = a, b, 1 << 60, True
        while True:
            if joined.get(x << 20 | y, 1 << 60) < first:
                out = False
                break
            p = halves[x] if x in halves else self.made_of(x)
            q = halves[y] if y in halves else self.made_of(y)
            if p is None and q is None:
                break
            if q is None or (p is not None and x > y):
                first, x = x, p[1]
            else:
                first, y = y + 1, q[0]
        if len(self.border) >= BORDERS * self.room:
            self.border.clear()
        self.border[a << 20 | b] = out
        return out

    def _state(self, before: int, held: bytes, lasts: tuple) -> int:
        """The number of the state: the token before the border or -1, the bytes since, and for each of their lengths the last token."""
        key = (before, held)
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append((before, held, lasts))
        return self.number[key]

    def _last(self, before: int, text: bytes, lasts: tuple) -> int:
        """The last token of the bytes since the border."""
        ranks, border_of = self.ranks, self.border
        for start in range(max(0, len(text) - self.longest), len(text)):
            token = ranks.get(text[start:])
            if token is not None:
                ahead = lasts[start - 1] if start else before
                if ahead == -1:
                    return token
                fits = border_of.get(ahead << 20 | token)
                if self.apart(ahead, token) if fits is None else fits:
                    return token
        raise ValueError("the ranks lack a byte")

    def step(self, state: int, byte: bytes) -> tuple[int, tuple[int, ...]]:
        """From a state by a byte: the next state, and the tokens that became certain."""
        before, held, lasts = self.states[state]
        text = held + byte
        lasts = (*lasts, self._last(before, text, lasts))
        if len(text) < LOOK:
            return self._state(before, text, lasts), ()
        # Every token still to come starts at the end or where a token that isn't complete may have begun; what all
        # chains of borders back from these places share is certain.
        chains = [1]
        for end, token in enumerate(lasts, 1):
            start = end - len(self.tokens[token])
            chains.append(chains[start] | 1 << end if start >= 0 else 0)  # 0: across the border, so no token will start here
        common = chains[-1]
        for i in range(max(0, len(text) - self.longest), len(text)):
            if text[i:] in self.opens:
                common &= chains[i]
        border = common.bit_length() - 1
        if not border:
            return self._state(before, text, lasts), ()
        out = self._back(lasts, border)
        return self._state(out[-1], text[border:], lasts[border:]), tuple(out)

    def _back(self, lasts: tuple, end: int) -> list[int]:
        """The tokens of the first ``end`` undecided bytes."""
        out = []
        while end > 0:
            out.append(lasts[end - 1])
            end -= len(self.tokens[out[-1]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """Tokens of one piece. Its last byte needs no next state, so none is made for it."""
        if not piece:
            return []
        if len(self.states) >= STATES * self.room:
            self.empty()
        out, state, table = [], 0, self.next
        for byte in piece[:-1]:
            move = table.get(state << 8 | byte)
            if move is None:
                move = table[state << 8 | byte] = self.step(state, bytes((byte,)))
            state = move[0]
            if move[1]:
                out += move[1]
        before, held, lasts = self.states[state]
        text = held + piece[-1:]
        return out + self._back((*lasts, self._last(before, text, lasts)), len(text))


class Packed:
    """The transducer over many pieces of at most ``LOOK`` bytes at once; its states last for one call."""

    _BASE, _A = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

    def __init__(self, machine: Transducer):
        self.machine = machine
        size = max(machine.tokens, default=0) + 1
        short = [(t, i) for t, i in machine.ranks.items() if len(t) <= LOOK]
        ids, n = np.array([i for _, i in short], np.int64), np.array([len(t) for t, _ in short], np.int64)
        self.bytes = np.zeros((size, LOOK), np.uint8)
        self.bytes[ids] = np.frombuffer(b"".join(t.ljust(LOOK, b"\0") for t, _ in short), np.uint8).reshape(-1, LOOK)
        h = np.zeros(len(ids), np.uint64)
        for i in range(LOOK):
            h = np.where(n > i, h * self._BASE + self.bytes[ids, i] + np.uint64(1), h)
        self.powers, self.most = [np.uint64(1)], int(n.max(initial=1))
        for _ in range(LOOK):
            self.powers.append(np.uint64((int(self.powers[-1]) * int(self._BASE)) % 2**64))
        self.by_hash = self._table((h + n.astype(np.uint64)) * self._A, ids)
        pair = np.fromiter(machine.joined, np.int64, len(machine.joined)).view(np.uint64)
        self.by_pair = self._table(pair * self._A, np.fromiter(machine.joined.values(), np.int64, len(pair)))
        self.halves = np.full((2, size), -2, np.int64)  # -1: a byte; -2: not known yet

    @staticmethod
    def _table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order, maybe = np.argsort(keys), np.zeros(1 << 20, bool)
        maybe[keys >> np.uint64(44)] = True
        return keys[order], values[order], maybe

    @staticmethod
    def _find(table: tuple, keys: np.ndarray, none: int) -> np.ndarray:
        known, values, maybe = table
        out = np.full(len(keys), none, np.int64)
        at = np.flatnonzero(maybe[keys >> np.uint64(44)])
        if len(at) and len(known):
            k = np.minimum(np.searchsorted(known, keys[at]), len(known) - 1)
            same = known[k] == keys[at]
            out[at[same]] = values[k[same]]
        return out

    def _split(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = self.halves
        for t in np.unique(token[left[token] == -2]).tolist():
            left[t], right[t] = self.machine.made_of(t) or (-1, -1)
        return left[token], right[token]

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """As ``Transducer.apart``, for each pair."""
        key, back = np.unique(a << 20 | b, return_inverse=True)
        x, y, first = key >> 20, key & ((1 << 20) - 1), np.full(len(key), 1 << 60)
        out, live = np.ones(len(key), bool), np.arange(len(key))
        while len(live):
            lost = self._find(self.by_pair, (x[live] << 20 | y[live]).view(np.uint64) * self._A, 1 << 60) < first[live]
            out[live[lost]] = False
            live = live[~lost]
            (p, p2), (q, _) = self._split(x[live]), self._split(y[live])
            on = (p >= 0) | (q >= 0)
            live, p, p2, q = live[on], p[on], p2[on], q[on]
            u, v = x[live], y[live]
            left = (q < 0) | ((p >= 0) & (u > v))
            first[live], x[live], y[live] = np.where(left, u, v + 1), np.where(left, p2, u), np.where(left, v, q)
        return out[back.reshape(-1)]

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """Tokens of each piece; none is empty."""
        if not pieces:
            return []
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join([p.ljust(LOOK, b"\0") for p in pieces]), np.uint8).reshape(-1, LOOK)
        room = int(n.sum()) + 1
        last, back, hashes = np.full(room, -1, np.int32), np.zeros(room, np.int32), np.zeros(room, np.uint64)
        state, end = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)  # within a level; among all
        path, held, base = np.zeros((1, 1), np.int32), np.zeros((1, 0), np.uint8), 1
        active = np.arange(len(pieces))
        for depth in range(1, int(n.max()) + 1):
            active = active[n[active] >= depth]
            key, at = np.unique(state[active] << 8 | raw[active, depth - 1], return_inverse=True)
            at = at.reshape(-1)
            new, parent, byte = slice(base, base + len(key)), key >> 8, (key & 255).astype(np.uint8)
            hashes[new] = hashes[path[parent, depth - 1]] * self._BASE + byte + np.uint64(1)
            path = np.concatenate([path[parent], np.arange(base, base + len(key), dtype=np.int32)[:, None]], 1)
            held = np.concatenate([held[parent], byte[:, None]], 1)
            self._lasts(depth, new, path, held, last, back, hashes)
            state[active], end[active] = at, base + at
            base += len(key)
        columns = []
        while end.any():
            columns.append(last[end])
            end = back[end]
        rows, count = np.stack(columns[::-1], 1).tolist(), (np.stack(columns, 1) >= 0).sum(1).tolist()
        return [r[-k:] for r, k in zip(rows, count)]

    def _lasts(self, depth, new, path, held, last, back, hashes) -> None:
        """The last token of each new state, and the state at its start."""
        open_, whole = np.arange(len(path)), hashes[new]
        for size in range(min(depth, self.most), 0, -1):
            start = depth - size
            key = (whole[open_] - hashes[path[open_, start]] * self.powers[size] + np.uint64(size)) * self._A
            token = self._find(self.by_hash, key, -1)
            hit = np.flatnonzero(token >= 0)
            if not len(hit):
                continue
            rows, token = open_[hit], token[hit]
            ok = (held[rows, start:] == self.bytes[token, :size]).all(1)
            if start:
                ok[ok] = self.apart(last[path[rows[ok], start]].astype(np.int64), token[ok])
            rows = rows[ok]
            last[new.start + rows], back[new.start + rows] = token[ok], path[rows, start]
            open_ = open_[last[new.start + open_] < 0]
            if not len(open_):
                return
        raise ValueError("the ranks lack a byte")


class Utf8Stream:
    """An incremental UTF-8 decoder. ``feed`` returns what is complete; ``close`` what is left."""

    #: By lead byte: continuation bytes, and the range of the first of them (RFC 3629).
    LEADS = (
        [(0, 0, 0)] * 128 + [None] * 66 + [(1, 0x80, 0xBF)] * 30
        + [(2, 0xA0, 0xBF)] + [(2, 0x80, 0xBF)] * 12 + [(2, 0x80, 0x9F)] + [(2, 0x80, 0xBF)] * 2
        + [(3, 0x90, 0xBF)] + [(3, 0x80, 0xBF)] * 3 + [(3, 0x80, 0x8F)] + [None] * 11
    )

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = self._complete(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out

    def _complete(self, data: bytes) -> int:
        """Where a character begins whose end is still to come; else the end."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if 0x80 <= lead <= 0xBF:
                continue
            rule = self.LEADS[lead]
            if rule and rule[0] >= back and (back == 1 or rule[1] <= data[1 - back] <= rule[2]):
                return len(data) - back
            break
        return len(data)


def through_utf8(parts) -> Iterator[bytes]:
    """Decoded bytes, as they come from the UTF-8 machine."""
    stream = Utf8Stream()
    for part in parts:
        yield stream.feed(part).encode("utf-8", "surrogatepass")
    yield stream.close().encode("utf-8", "surrogatepass")


class Coded:
    """A text's tokens, chunk by chunk, in blocks."""

    def __init__(self, codec: Codec, blocks: list[list[tuple[int, ...]]]):
        self.codec, self.blocks = codec, [b for b in blocks if b]

    def ids(self) -> list[int]:
        return list(chain.from_iterable(chain.from_iterable(self.blocks)))

    def count(self) -> int:
        return sum(sum(map(len, block)) for block in self.blocks)

    def ids_sha256(self) -> str:
        """Of the decimal ids joined by commas."""
        out, between, decimal = hashlib.sha256(), b"", self.codec.decimal.__getitem__
        for block in self.blocks:
            out.update(between + ",".join(map(decimal, chain.from_iterable(block))).encode())
            between = b","
        return out.hexdigest()

    def decoded_sha256(self) -> str:
        """Of the bytes that the ids decode to."""
        out, token = hashlib.sha256(), self.codec.machine.tokens.__getitem__
        for part in through_utf8(b"".join(map(token, chain.from_iterable(block))) for block in self.blocks):
            out.update(part)
        return out.hexdigest()


class Codec:
    """A tokenizer: a pattern that cuts text into pieces, and a transducer. room: tables hold this share of their sizes above."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, room: float = 1.0):
        self.machine, self.pattern = Transducer(ranks, room), regex.compile(pattern)
        self.packed = Packed(self.machine)
        self.spaced = pattern in SPACED
        self.cut = _CHUNK if self.spaced else self.pattern
        self.decimal = {i: str(i) for i in self.machine.tokens}
        self.kept: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.long: list[str] = []

    def empty(self) -> None:
        """Forget what was met so far."""
        self.kept, self.older, self.long = {}, {}, []
        self.machine.empty()

    def learn(self, lists: list[list[str]]) -> dict[str, tuple[int, ...]]:
        """A table that has every chunk of these lists."""
        for c in self.long:
            self.kept.pop(c, None)
        here = set().union(*lists)
        new = here - self.kept.keys()
        if len(self.kept) + len(new) > CHUNKS * self.machine.room:
            self.older, self.kept = self.kept, {}
            new = here
        before = new & self.older.keys()
        self.kept.update(zip(before, map(self.older.__getitem__, before)))
        new = list(new - before)
        self.long = [c for c in new if len(c) > KEPT_CHUNK]
        parts = list(map(self.pattern.findall, new)) if self.spaced else [[c] for c in new]
        pieces = list(set().union(*parts))
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        short = iter(self.packed.encode([r for r in raw if len(r) <= LOOK]))
        known = {p: tuple(next(short) if len(r) <= LOOK else self.machine.encode(r)) for p, r in zip(pieces, raw)}
        for c, some in zip(new, parts):
            self.kept[c] = known[some[0]] if len(some) == 1 else tuple(chain.from_iterable(map(known.__getitem__, some)))
        return self.kept

    def entries(self, text: str) -> Iterator[list[tuple[int, ...]]]:
        """The ids of the chunks of a text, block by block."""
        for chunks in self._blocks(text):
            yield list(map(self.learn([chunks]).__getitem__, chunks))

    def code(self, texts: list[str]) -> Iterator[Coded]:
        """Each of some texts, whose chunks are held together; a long one is alone."""
        if len(texts) == 1 and len(texts[0]) > BLOCK:
            yield Coded(self, list(self.entries(texts[0])))
            return
        lists = list(map(self.cut.findall, texts))
        table = self.learn(lists)
        for chunks in lists:
            yield Coded(self, [list(map(table.__getitem__, chunks))])

    def _blocks(self, text: str) -> Iterator[list[str]]:
        """The chunks of a text; of a long one, block by block."""
        if len(text) <= BLOCK:
            yield self.cut.findall(text)
            return
        block = []
        for m in self.cut.finditer(text):
            block.append(m[0])
            if len(block) == BLOCK:
                yield block
                block = []
        yield block

    def encode(self, text: str) -> list[int]:
        return Coded(self, list(self.entries(text))).ids()

    def ids_text(self, ids: list[int]) -> str:
        """Decimal ids joined by commas."""
        decimal = self.decimal
        return ",".join([decimal[i] for i in ids])

    def decode(self, ids: list[int], block: int = 4096) -> bytes:
        """The text's bytes, made block by block through the UTF-8 machine."""
        tokens = self.machine.tokens
        return b"".join(through_utf8(b"".join([tokens[i] for i in ids[at : at + block]]) for at in range(0, len(ids), block)))


_codecs: dict[tuple, Codec] = {}
CACHES.append(_codecs)


def codec(ranks: bytes, pattern: str, room: float = 1.0) -> Codec:
    """The codec of a rank file's content, one a process."""
    key = (hashlib.sha256(ranks).digest(), pattern, room)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(read_ranks(ranks), pattern, room)
    return _codecs[key]


def codec_for_task(ranks: bytes, pattern: str, room: float) -> Codec:
    """The codec, after other operators' tables are gone."""
    release(_codecs)
    return codec(ranks, pattern, room)


def _groups(texts: list[str | None]) -> Iterator[list[str]]:
    """Runs of texts of ``CHARS`` characters or so; one that is longer is alone."""
    some, size = [], 0
    for t in texts:
        t = t or ""
        if some and size + len(t) > CHARS:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


def tokenize(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out: dict[str, tuple] | None = None, room: float = 1.0) -> DataFrame:
    """df with columns made from the tokens of each whole text.

    out: name -> (Arrow type, Spark type, function of a ``Coded``); by default ``tokens array<int>``. A name that df
    has already replaces that column. ranks_path is read on the driver and broadcast: a vocabulary is of fixed size.
    room trades a worker's memory for time; it changes no result.

    Null and empty texts have no tokens. Ids are those of ordinary text; no special tokens. Very long texts are cut and
    coded block by block. Equal texts get equal tokens, repeated rows stay. Other columns pass through. An empty table
    stays empty.
    """
    out = out or tokens()
    with open(ranks_path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    rest, own = scratch.others(df, out), scratch.prefix(df)
    made = [(k, t, f) for k, (t, _, f) in out.items()]

    def run(batches):
        c = codec_for_task(shared.value, pattern, room)
        collecting = gc.isenabled()
        gc.disable()  # the tables hold millions of tuples and no cycles
        try:
            for b in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
                values = [[] for _ in made]
                for some in _groups(b.column(len(rest)).to_pylist()):
                    for coded in c.code(some):
                        for v, (_, _, f) in zip(values, made):
                            v.append(f(coded))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], *(pa.array(v, t) for v, (_, t, _) in zip(values, made))], names=[*rest, *(k for k, _, _ in made)])
        finally:
            c.empty()
            if collecting:
                gc.enable()
            release(_codecs)

    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    schema = StructType([df.schema[c] for c in rest] + [StructField(k, _parse_datatype_string(t), True) for k, (_, t, _) in out.items()])
    return df.select(*[f"`{c}`" for c in rest], F.col(text_col).alias(f"{own}text")).mapInArrow(run, schema)


def tokens() -> dict[str, tuple]:
    """The column of a text's token ids."""
    return {"tokens": (pa.list_(pa.int32()), "array<int>", Coded.ids)}


def digests() -> dict[str, tuple]:
    """Columns that stand for a text's tokens and for its bytes as decoded from them."""
    return {
        "n_tokens": (pa.int64(), "bigint", Coded.count),
        "ids_sha256": (pa.string(), "string", Coded.ids_sha256),
        "decoded_sha256": (pa.string(), "string", Coded.decoded_sha256),
    }


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = tokenize(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, out=digests())
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
