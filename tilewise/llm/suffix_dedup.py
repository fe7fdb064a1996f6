"""Removal of byte strings that an earlier document already has, by blockwise sorted suffixes.

Every window of ``length`` bytes is judged. How equal windows meet without shuffling a window at a time:

1. A window is named by its minimizer: of its 16-byte grams, the one with the least hash, leftmost first. Neighbouring
   windows mostly share one, and travel as one stretch of text (``length`` + 16 bytes on average) to the bucket that
   the gram's hash names. Within a chunk of documents, equal stretches of later documents are settled at once and only
   the earliest document's is sent, so a passage that everyone has arrives once a chunk, not once a document.
2. In a bucket, windows whose first and last 8 bytes no other document has together are dropped; what that leaves is
   nearly all repeated. Its stretches are laid out in one text, every gram at a multiple of ``V``, and its windows are
   sorted as suffixes, blockwise: ranks of the suffixes that start on a difference cover modulo
   ``V`` are computed once, by doubling; then one bucket of leading bytes is sorted at a time, by 16 bytes and, where
   these tie, by the rank of the cover suffix a few bytes on. Memory is bounded by the cover and one suffix bucket.
   Equal windows hold their gram at the same place, so they start in the same class modulo V and one distance to the
   cover serves each class; classes stay apart within a tie, which no equal pair spans.
3. Neighbours in that order that agree in all ``length`` bytes are equal windows; each is removed where the least
   doc_id of its run is smaller. Spans go to their document and cut its text.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewise.llm import scratch
from tilewise.llm.memory import release

#: Bytes of the gram that names a window; a difference cover modulo V, and V.
GRAM = 16
COVER, V = (0, 1, 2, 5, 8), 16
#: Bytes of text in a chunk of a task, windows named at once, bytes in a bucket of stretches, bytes of text in a bucket of documents, windows sorted at once.
CHUNK, PART, BUCKET, DOCS, SORTED = 1 << 23, 1 << 20, 3 << 22, 1 << 24, 1 << 18
#: Texts, and characters of each, that a dictionary for compression is made of: a hundred kilobytes or so.
SAMPLE, SAMPLE_TEXT = 60, 2000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_POS = np.uint64((1 << 24) - 1)


class Packer:
    """Arrays as one compressed value. Values are small where buckets are many, so a sample of the texts serves as their dictionary."""

    def __init__(self, sample: bytes = b""):
        table = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(sample) >= 8 else None
        if table:
            table.precompute_compress(level=6)
        self.writer = zstandard.ZstdCompressor(level=6, dict_data=table)
        self.reader = zstandard.ZstdDecompressor(dict_data=table)

    def pack(self, *arrays: np.ndarray) -> bytes:
        head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<3sQ", a.dtype.str.encode(), a.nbytes) for a in arrays)
        return self.writer.compress(head + b"".join(a.tobytes() for a in arrays))

    def unpack(self, blob: bytes) -> list[np.ndarray]:
        raw = self.reader.decompress(blob)
        out, at = [], 1 + 11 * raw[0]
        for i in range(raw[0]):
            kind, size = struct.unpack_from("<3sQ", raw, 1 + 11 * i)
            kind = np.dtype(kind.decode())
            out.append(np.frombuffer(raw, kind, size // kind.itemsize, at))
            at += size
        return out


PLAIN = Packer()
_packers: dict[bytes, Packer] = {}


def _packer(sample: bytes) -> Packer:
    """The packer of a sample; a process keeps a few."""
    if sample not in _packers:
        if len(_packers) > 3:
            _packers.clear()
        _packers[sample] = Packer(sample)
    return _packers[sample]


def _delta(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def _load(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place, as numbers in the order of the bytes."""
    return np.ndarray((len(text) - 7,), ">u8", text, strides=(1,))[at].astype(np.uint64)


def _dense(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of numbers among the distinct ones, and how many those are."""
    order = np.argsort(x)
    rank = np.empty(len(x), np.uint64)
    rank[order] = np.cumsum(np.diff(x[order], prepend=x[order[:1]]) != 0).astype(np.uint64)
    return rank, int(rank[order[-1]]) + 1 if len(x) else 0


def _keys(text: np.ndarray, length: int) -> np.ndarray:
    """For each window of text: the least hash of its grams in the high bits, the gram's place (leftmost) in the low 24."""
    w2 = text[:-1].astype(np.uint16) | (text[1:].astype(np.uint16) << np.uint16(8))
    w4 = w2[:-2].astype(np.uint32) | (w2[2:].astype(np.uint32) << np.uint32(16))
    w8 = w4[:-4].astype(np.uint64) | (w4[4:].astype(np.uint64) << np.uint64(32))
    key = w8[:-8] * _A
    key ^= key >> np.uint64(29)
    key += w8[8:] * _B
    key ^= key >> np.uint64(32)
    key *= _C
    key &= ~_POS
    key |= np.arange(len(key), dtype=np.uint64)
    span, have = length - GRAM + 1, 1
    while have < span:
        step = min(have, span - have)
        key = np.minimum(key[:-step], key[step:])
        have += step
    return key


def stretches(raw: bytes, bounds: np.ndarray, length: int):
    """Runs of windows with one minimizer: first window, last window, the gram's place, its hash; no run leaves a document.

    bounds: where each document starts in raw, and its end. Keys are made for a part of the text at a time.
    """
    text, none = np.frombuffer(raw, np.uint8), np.uint64(2**64 - 1)
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for lo in range(0, len(text) - length + 1, PART):
        key = _keys(text[lo : lo + PART + length - 1], length)
        near = bounds[1:-1][np.searchsorted(bounds[1:-1], lo) : np.searchsorted(bounds[1:-1], lo + len(key) + length)]
        crossing = (near[:, None] - lo - np.arange(1, length)).reshape(-1)
        key[crossing[(crossing >= 0) & (crossing < len(key))]] = none
        first = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        last = np.append(first[1:], len(key)) - 1
        key = key[first]
        real = key != none
        first, last, key = first[real], last[real], key[real]
        parts.append((first + lo, last + lo, (key & _POS).astype(np.int64) + lo, key >> np.uint64(24)))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _chunk(docs: list[tuple[int, bytes, int]], length: int, buckets: int, packer: Packer = PLAIN):
    """(bucket, blob) of a chunk of documents (id, text, tag): its distinct stretches, where the earliest document has them, and spans of later ones.

    The tag tells rows of one id with different texts apart: spans are of a row, comparisons by id.
    """
    docs.sort(key=lambda d: d[0])
    raw = b"".join(d[1] for d in docs)
    ids, tags = np.array([d[0] for d in docs], np.int64), np.array([d[2] for d in docs], np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(d[1]) for d in docs])]).astype(np.int64)
    first, last, gram, h = stretches(raw, bounds, length)
    if not len(first):
        return
    bucket = (h % np.uint64(buckets)).astype(np.uint16 if buckets < 65536 else np.int64)
    order = np.argsort(bucket, kind="stable")
    first, last, gram, bucket = first[order], last[order], gram[order], bucket[order]
    owner = np.searchsorted(bounds, first, side="right") - 1
    doc, off, tag = ids[owner], first - bounds[owner], tags[owner]
    end = last + length
    kind = np.uint8 if 2 * length - GRAM < 256 else np.uint16  # the longest stretch
    cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        seen: dict[bytes, int] = {}
        code = np.array([seen.setdefault(raw[s:e], len(seen)) for s, e in zip(first[lo:hi].tolist(), end[lo:hi].tolist())], np.int64)
        d, o, n, t = doc[lo:hi], off[lo:hi], (end - first)[lo:hi], tag[lo:hi]
        least, at = np.empty(len(seen), np.int64), np.empty(len(seen), np.int64)
        least[code[::-1]], at[code[::-1]] = d[::-1], np.arange(hi - lo)[::-1]
        keep = d == least[code]
        place = (gram - first)[lo:hi][at].astype(np.uint8)
        yield int(bucket[lo]), packer.pack(
            np.frombuffer(b"".join(seen), np.uint8), n[at].astype(kind), place, _delta(least),
            _delta(code[keep]).astype(np.int32), o[keep].astype(np.uint32), _delta(d[~keep]), o[~keep].astype(np.uint32), n[~keep].astype(kind),
            t[keep], t[~keep],
        )


def _ranks(text: np.ndarray, sample: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes at sample by at least their first ``depth`` bytes; sample is closed under steps of V up to its end."""
    (a, _), (b, n) = _dense(_load(text, sample)), _dense(_load(text, sample + 8))
    rank, _ = _dense(a * np.uint64(n) + b)
    step, per = 1, len(COVER)
    have = V
    while have < depth:
        on = np.zeros(len(sample), np.uint64)
        on[: -step * per or None] = rank[step * per :] + np.uint64(1)
        rank, _ = _dense(rank * np.uint64(len(sample) + 1) + on)
        step, have = 2 * step, 2 * have
    return rank


def _windows(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of each stretch, in order: its stretch and its place there."""
    n = sizes - length + 1
    return np.repeat(np.arange(len(sizes)), n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _candidates(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """A flag for each window: whether another document may have it, by a hash of its first and last 8 bytes. No repeated one is missed."""
    bits = max(10, min(24, int(np.sum(sizes)).bit_length() + 1))
    shift = np.uint64(64 - bits)
    code = np.unique(doc, return_inverse=True)[1].reshape(-1).astype(np.int32)
    owner, many, parts = np.full(1 << bits, -1, np.int32), np.zeros(1 << bits, bool), []
    for lo in range(0, len(sizes), SORTED // 8):  # some stretches at a time
        some = slice(lo, lo + SORTED // 8)
        of, place = _windows(sizes[some], length)
        at = starts[some][of] + place
        h = _load(text, at) * _A
        h = ((h ^ (h >> np.uint64(31))) + _load(text, at + length - 8) * _B) * _C
        h = ((h ^ (h >> np.uint64(29))) * _A >> shift).astype(np.int32)
        mine = code[some][of]
        was = owner[h]
        owner[h] = mine
        many[h[(owner[h] != mine) | ((was >= 0) & (was != mine))]] = True
        parts.append(h)
    return many[np.concatenate(parts)]


def repeated(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, place: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """A flag for each window of each stretch, in order: whether a stretch with a smaller doc has it too.

    text holds the stretches; place is where each has its gram. Equal windows must have it at the same distance.
    """
    maybe = _candidates(text, starts, sizes, doc, length)
    used = np.add.reduceat(maybe, np.cumsum(sizes - length + 1) - (sizes - length + 1)) > 0
    if not used.any():
        return np.zeros(len(maybe), bool)
    of, at = _windows(sizes, length)
    on = used[of]
    of, at, maybe = (np.cumsum(used) - 1)[of[on]], at[on], maybe[on]
    starts, sizes, place, doc = starts[used], sizes[used], place[used], doc[used]
    # Equal stretches have one place in the order; it stands for the least of their documents.
    seen: dict[bytes, int] = {}
    code = np.array([seen.setdefault(text[s : s + n].tobytes(), len(seen)) for s, n in zip(starts.tolist(), sizes.tolist())])
    first = np.flatnonzero(np.diff(np.maximum.accumulate(code), prepend=-1))
    earliest = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(earliest, code, doc)
    wins = sizes[first] - length + 1
    to = (np.cumsum(wins) - wins)[code[of]] + at
    wanted = np.zeros(int(wins.sum()), bool)
    wanted[to[maybe]] = True
    least = _least(text, starts[first], sizes[first], place[first], earliest, wanted, length)
    flag = np.zeros(len(on), bool)
    flag[on] = least[to] < doc[of]
    return flag


def _least(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, place: np.ndarray, doc: np.ndarray, wanted: np.ndarray, length: int) -> np.ndarray:
    """For each wanted window of these stretches the least doc that has it, from the order of their suffixes."""
    lead = -place % V
    slot = -(-(lead + sizes) // V) * V
    base = np.cumsum(slot) - slot
    laid = np.zeros(int(slot.sum()) + 8 * V, np.uint8)
    for lo in range(0, len(sizes), SORTED // 8):
        some = slice(lo, lo + SORTED // 8)
        n = sizes[some]
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        laid[np.repeat((base + lead)[some], n) + k] = text[np.repeat(starts[some], n) + k]
    sample = (np.arange(0, len(laid) - 2 * V, V)[:, None] + np.array(COVER)).reshape(-1)
    rank = _ranks(laid, sample, length)
    # from each class, the distance to the cover and the cover's number in its row
    far = np.array([min((c - r) % V for c in COVER) for r in range(V)])
    rows = np.array([COVER.index((r + far[r]) % V) for r in range(V)])
    owner, at = (x[wanted] for x in _windows(sizes, length))
    at += (base + lead)[owner]
    found = np.empty(len(at), np.int64)
    lead2 = laid[at].astype(np.int32) * 256 + laid[at + 1]
    group = (np.cumsum(np.bincount(lead2, minlength=65536)) - 1) // SORTED
    by = group[lead2].astype(np.int32)
    for g in np.unique(by):
        w = np.flatnonzero(by == g)
        p = at[w]
        r = p % V
        (a, _), (b, n) = _dense(_load(laid, p)), _dense(_load(laid, p + 8))
        tie = rank[(p + far[r]) // V * len(COVER) + rows[r]] + r.astype(np.uint64) * np.uint64(len(sample))
        head, _ = _dense(a * np.uint64(n) + b)
        tail, n = _dense(tie)
        order = np.argsort(head * np.uint64(n) + tail)
        w, p, head = w[order], p[order], head[order]
        same = head[1:] == head[:-1]
        near = np.flatnonzero(same)
        for step in [*range(16, length - 8, 8), length - 8]:
            near = near[_load(laid, p[near] + step) == _load(laid, p[near + 1] + step)]
        same[:] = False
        same[near] = True
        runs = np.concatenate([[0], np.flatnonzero(~same) + 1])
        d = doc[owner[w]]
        found[w] = np.repeat(np.minimum.reduceat(d, runs), np.diff(np.append(runs, len(d))))
    out = np.full(len(wanted), np.iinfo(np.int64).max)
    out[wanted] = found
    return out


def _bucket(blobs, length: int, packer: Packer = PLAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (doc, start, end) to remove that the stretches of one bucket show."""
    doc, _, start, end = _spans(blobs, length, packer)
    return doc, start, end


def _spans(blobs, length: int, packer: Packer = PLAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans (doc, tag, start, end) to remove that the stretches of one bucket show."""
    texts, sizes, places, docs, codes, offs, owners, spans, shift = [], [], [], [], [], [], [], [], 0
    for blob in blobs:
        text, size, place, doc, code, off, d, o, n, t, rest = packer.unpack(blob)
        texts.append(text)
        sizes.append(size.astype(np.int64))
        places.append(place.astype(np.int64))
        docs.append(np.cumsum(doc))
        codes.append(np.cumsum(code.astype(np.int64)) + shift)
        offs.append(off.astype(np.int64))
        owners.append(t)
        shift += len(size)
        spans.append((np.cumsum(d), rest, o.astype(np.int64), o.astype(np.int64) + n))
    text, size, place, doc, code, off, owner = (np.concatenate(x) for x in (texts, sizes, places, docs, codes, offs, owners))
    start = np.cumsum(size) - size
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    (a, _), (b, n) = _dense(_load(padded, start + place)), _dense(_load(padded, start + place + 8))
    gram = a * np.uint64(n) + b
    order = np.argsort(gram)
    runs = np.concatenate([[0], np.flatnonzero(np.diff(gram[order])) + 1])
    d = doc[order]
    shared = np.minimum.reduceat(d, runs) != np.maximum.reduceat(d, runs)
    hot = np.sort(order[np.repeat(shared, np.diff(np.append(runs, len(order))))])
    if len(hot):
        flag = repeated(text, start[hot], size[hot], place[hot], doc[hot], length)
        wins = size[hot] - length + 1
        head = np.cumsum(wins) - wins
        edge = flag.copy()
        edge[1:] &= ~flag[:-1]
        edge[head] = flag[head]
        stop = flag.copy()
        stop[:-1] &= ~flag[1:]
        tail = head + wins - 1
        stop[tail] = flag[tail]
        i, j = np.flatnonzero(edge), np.flatnonzero(stop)
        which = np.searchsorted(head, i, side="right") - 1
        lo, hi, which = i - head[which], j - head[which] + length, hot[which]
        order = np.argsort(code, kind="stable")
        sorted_ = code[order]
        f, l = np.searchsorted(sorted_, which), np.searchsorted(sorted_, which, side="right")
        n = l - f
        at = order[np.repeat(f, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        spans.append((np.repeat(doc[which], n), owner[at], off[at] + np.repeat(lo, n), off[at] + np.repeat(hi, n)))
    return tuple(np.concatenate(x) for x in zip(*spans))


def _union(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    at = np.flatnonzero(new)
    return start[at], end[np.append(at[1:], len(end)) - 1]


def _home(doc: np.ndarray, homes: int) -> np.ndarray:
    x = doc.view(np.uint64) * _A
    return ((x ^ (x >> np.uint64(32))) * _B >> np.uint64(33)) % np.uint64(homes)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, finish=None, schema=None) -> DataFrame:
    """df with its texts shortened by every byte that a ``length``-byte string covers which a smaller id has, too.

    Strings are bytes of UTF-8 and are judged on the texts as given. A cut inside a character leaves bytes that are no
    UTF-8; they become U+FFFD in the text. ``finish(batch, kept, spans)`` and ``schema`` return something other than the
    rows: kept are the remaining bytes of each row, spans the removed (start, end) pairs.

    Null text: as empty; it stays null. A row with a null id loses nothing and takes nothing from others. Rows that
    share an id take nothing from each other, and each loses what it shares with smaller ids, whatever the others of its
    id lose. Texts shorter than ``length`` stay. Other columns pass through unread. An empty table stays empty.
    """
    if not GRAM <= length <= 200:
        raise ValueError("length must be from 16 to 200 bytes")
    names = df.columns
    where, own = names.index(text_col), scratch.prefix(df)
    ids, text_hash = F.col(id_col).cast("bigint"), F.xxhash64(text_col)
    each = df.select(ids.alias("d"), F.octet_length(text_col).alias("n"), text_hash.alias("h")).groupBy("d").agg(F.sum("n").alias("n"), F.count("*").alias("c"), F.min("h").alias("a"), F.max("h").alias("b"))
    mixed = F.col("d").isNotNull() & (F.col("a") != F.col("b"))
    size, count, differ = each.agg(F.sum("n"), F.sum("c"), F.max(mixed)).first()
    size, count = size or 0, count or 0
    tagged = df.withColumns({f"{own}id": ids, f"{own}tag": F.lit(0).cast("bigint")})
    if differ:  # rows of these ids are told apart by their text
        several = each.where(mixed).select(F.col("d").alias(f"{own}several"))
        known = df.withColumn(f"{own}id", ids).join(several, F.col(f"{own}id") == F.col(f"{own}several"), "left")
        tagged = known.withColumn(f"{own}tag", F.when(F.col(f"{own}several").isNotNull(), text_hash).otherwise(0)).drop(f"{own}several")
    # Only for compression: the beginnings of SAMPLE texts or so, chosen by a hash.
    drawn = df.where(F.shiftrightunsigned(F.xxhash64(id_col, F.lit("sample")), 11) * F.lit(2.0**-53) < SAMPLE / max(1, count))
    some = drawn.select(F.substring(text_col, 1, SAMPLE_TEXT)).limit(2 * SAMPLE).collect()
    sample = df.sparkSession.sparkContext.broadcast("".join(r[0] or "" for r in some).encode("utf-8", "surrogatepass"))
    buckets, homes = max(12, 4 * size // BUCKET), max(12, size // DOCS)

    def cut(batches):
        release()
        docs, held = [], 0
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            for doc, text, tag in zip(*(c.to_pylist() for c in batch.columns)):
                raw = (text or "").encode("utf-8", "surrogatepass")
                if doc is None or len(raw) < length:
                    continue
                for at in range(0, len(raw), CHUNK):  # parts of a very long text overlap by length - 1
                    part = raw[at : at + CHUNK + length - 1]
                    if held + len(part) > CHUNK + length and docs:
                        yield from emit(docs)
                        docs, held = [], 0
                    docs.append((doc, part, at, tag))
                    held += len(part)
        yield from emit(docs)
        del docs
        release()

    def emit(docs):
        rows = list(_parts(docs, length, buckets, _packer(sample.value))) if docs else []
        for i in range(0, len(rows), 256):
            part = rows[i : i + 256]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.binary())], names=["bucket", "blob"])

    def sort(table: pa.Table) -> pa.Table:
        release()
        doc, tag, start, end = _spans((x.as_py() for x in table.column("blob")), length, _packer(sample.value))
        home = _home(doc, homes)
        order = np.lexsort((start, tag, doc, home))
        doc, tag, start, end, home = doc[order], tag[order], start[order], end[order], home[order]
        cuts = np.concatenate([[0], np.flatnonzero(home[1:] != home[:-1]) + 1, [len(home)]]) if len(home) else np.zeros(1, np.int64)
        blobs = [_packer(b"").pack(_delta(doc[a:b]), tag[a:b], start[a:b].astype(np.uint32), end[a:b].astype(np.uint32)) for a, b in zip(cuts[:-1], cuts[1:])]
        return pa.table({"home": pa.array(home[cuts[:-1]].astype(np.int32), pa.int32()), "spans": pa.array(blobs, pa.binary()), "rows": pa.nulls(len(blobs), pa.binary())})

    def deal(batches):
        for batch in batches:
            ids = batch.column(len(names))
            no_id = ids.is_null().to_numpy(zero_copy_only=False)  # these rows meet nothing and go anywhere
            home = _home(np.where(no_id, np.arange(len(no_id)), ids.fill_null(0).to_numpy(zero_copy_only=False)), homes)
            order = np.argsort(home, kind="stable")
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(home[order].astype(np.int64))) + 1, [len(order)]]) if len(order) else np.zeros(1, np.int64)
            for a, b in zip(cuts[:-1], cuts[1:]):
                out = pa.BufferOutputStream()
                part = batch.take(pa.array(order[a:b]))
                with pa.ipc.new_stream(out, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as w:
                    w.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([int(home[order[a]])], pa.int32()), pa.nulls(1, pa.binary()), pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["home", "spans", "rows"])

    def rows(batch, kept, spans):
        text = [None if t is None else k.decode("utf-8", "replace") for t, k in zip(batch.column(where).to_pylist(), kept)]
        return pa.RecordBatch.from_arrays([pa.array(text, pa.string()) if i == where else batch.column(i) for i in range(len(names))], names=names)

    finish = finish or rows

    def merge(table: pa.Table) -> pa.Table:
        found = [_packer(b"").unpack(x.as_py()) for x in table.column("spans") if x.is_valid]
        by: dict[tuple[int, int], tuple] = {}
        if found:
            doc, tag, start, end = (np.concatenate(x) for x in zip(*((np.cumsum(d), t, s.astype(np.int64), e.astype(np.int64)) for d, t, s, e in found)))
            order = np.lexsort((tag, doc))
            doc, tag, start, end = doc[order], tag[order], start[order], end[order]
            cuts = np.concatenate([[0], np.flatnonzero((doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])) + 1, [len(doc)]])
            by = {(int(doc[a]), int(tag[a])): _union(start[a:b], end[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())}
        out = []
        for blob in table.column("rows"):
            if not blob.is_valid:
                continue
            for batch in pa.ipc.open_stream(blob.as_buffer()):
                kept, spans = [], []
                for doc, tag, text in zip(*(batch.column(i).to_pylist() for i in (len(names), len(names) + 1, where))):
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    pairs, at, parts = [], 0, []
                    for s, e in zip(*(x.tolist() for x in by[doc, tag])) if (doc, tag) in by else ():
                        pairs.append((s, e))
                        parts.append(raw[at:s])
                        at = e
                    kept.append(b"".join([*parts, raw[at:]]))
                    spans.append(pairs)
                out.append(finish(batch, kept, spans))
        return pa.Table.from_batches(out) if out else empty

    schema = df.schema if schema is None else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = df.sparkSession.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    empty = to_arrow_schema(kind).empty_table()
    spans = tagged.select(f"{own}id", text_col, f"{own}tag").mapInArrow(cut, "bucket int, blob binary").groupBy("bucket").applyInArrow(sort, "home int, spans binary, rows binary")
    dealt = tagged.select(*[f"`{c}`" for c in names], f"{own}id", f"{own}tag").mapInArrow(deal, "home int, spans binary, rows binary")
    return spans.union(dealt).groupBy("home").applyInArrow(merge, schema)


def _parts(docs: list[tuple], length: int, buckets: int, packer: Packer = PLAIN):
    """As _chunk, for parts of documents (id, bytes, offset, tag or none); each part's offset is added to its spans' places."""
    docs = [(d, raw, at, *(tag or (0,))) for d, raw, at, *tag in docs]
    if all(at == 0 for _, _, at, _ in docs):
        yield from _chunk([(d, raw, tag) for d, raw, _, tag in docs], length, buckets, packer)
        return
    for d, raw, at, tag in docs:
        for bucket, blob in _chunk([(d, raw, tag)], length, buckets, packer):
            x = packer.unpack(blob)
            yield bucket, packer.pack(*x[:5], x[5] + np.uint32(at), *x[6:7], x[7] + np.uint32(at), *x[8:])


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What each document loses to strings of 50 bytes that a smaller doc_id has."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def digest(batch, kept, spans):
        size = [len(k) for k in kept]
        gone = [sum(e - s for s, e in x) for x in spans]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([a + b for a, b in zip(size, gone)], pa.int64()), pa.array(gone, pa.int64()), pa.array([len(x) for x in spans], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    return remove_repeats(docs, finish=digest, schema="doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
