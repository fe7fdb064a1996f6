"""Scores of texts by an n-gram language model of part of them, in one exchange of n-grams.

1. Texts become chunks of a few megabytes: the distinct words, how often training texts have them, and the texts as places
   among these. Chunks are written once.
2. Words go to buckets by their hash, where counts are summed and words get numbers, frequent ones small numbers; each
   chunk gets the numbers and counts of its words back. A word that no training text has is unknown.
3. Each chunk sends its distinct triples of words (two before, one after) with their training counts to the shard of the
   middle word. A shard has all that follows a word, so it builds that part of the trie (``ngram_trie``), with its smoothed
   probabilities, and answers every chunk's triples by lookups in the mapped levels.
4. Chunks put answers, in the order in which they asked, to their texts.

No word is a hot spot: a word with more than half of a shard's share of all tokens is split by the word before it into
classes, each with a shard of its own, and the shorter context of a triple is then the word and the class. A triple travels
once a chunk, however often it is there. All counts cover all training texts; nothing is pruned.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewise.llm import scratch
from tilewise.llm.arrays import narrow, pack, unpack
from tilewise.llm.memory import release
from tilewise.llm.ngram_trie import VALUES, Trie

#: Bytes of text in a chunk and read at once; words of chunks in a bucket; tokens in a shard; least numbers of both.
CHUNK, PIECE, WORDS, TOKENS, LEAST = 6_000_000, 1 << 20, 1 << 19, 1 << 20, 12
#: Numbers of what is before the first word, of unknown words, and of the first word.
BEFORE, UNKNOWN, FIRST = 0, 1, 2
_TABLE = bytes(c + 32 if 65 <= c < 91 else 32 if 9 <= c < 14 else c for c in range(256))
_MASK = (1 << 21) - 1


def pieces(raw: bytes):
    """(words, whether it is the last) of parts of a text of about ``PIECE`` bytes; A-Z are lower-cased."""
    raw, at = raw.translate(_TABLE), 0
    while True:
        end = raw.find(b" ", at + PIECE) if len(raw) - at > PIECE else -1
        yield raw[at : end if end >= 0 else len(raw)].split(), end < 0
        if end < 0:
            return
        at = end


class _Places(dict):
    """The place of each word, a new one for one that isn't there."""

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self) + 1
        return at


class _Chunk:
    """Texts that become a chunk. Place 0 is before the first word, 1 the end."""

    def __init__(self):
        self.place = _Places({b"": 1})
        self.tokens: list[np.ndarray] = []
        self.meta: list[tuple] = []
        self.size = 0

    def add(self, uid: int, doc: int | None, train: bool, before: tuple, words: list[bytes]) -> None:
        old = [self.place[w] if w else 0 for w in before]
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        self.tokens.append(at)
        self.meta.append((uid, doc or 0, doc is None, train, *old, len(at)))
        self.size += sum(map(len, words)) + len(words) + 1

    def close(self) -> tuple[int, int, bytes, bytes]:
        """(words, tokens, words as a blob, texts as a blob). Words are in the order of their hash, for buckets are ranges of it."""
        words = list(self.place)
        hashed = np.array([zlib.crc32(w) for w in words], np.int64)
        order = np.argsort(hashed, kind="stable")
        to = np.empty(len(words) + 1, np.int64)
        to[0], to[order + 1] = 0, np.arange(len(words)) + 1
        tokens = to[np.concatenate(self.tokens)]
        uid, doc, null, train, u, v, n = (np.array(x) for x in zip(*self.meta))
        count = np.bincount(tokens[np.repeat(train, n)], minlength=len(words) + 1)[1:]
        listed = [words[i] for i in order.tolist()]
        told = pack(np.frombuffer(b"".join(listed), np.uint8), narrow(np.array([len(w) for w in listed])), narrow(count), hashed[order].astype(np.uint32))
        texts = pack(narrow(tokens), uid, doc.astype(np.int64), null.astype(np.uint8), train.astype(np.uint8), narrow(to[u]), narrow(to[v]), narrow(n), np.array([to[1]]))
        return len(words), len(tokens), told, texts


def _words(letters: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    raw, ends = letters.tobytes(), np.cumsum(sizes.astype(np.int64))
    return [raw[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]


def _chunks(df: DataFrame) -> DataFrame:
    """(chunk, n_words, n_tokens, words, texts) of rows (id, text as binary, train)."""

    def run(batches):
        release()
        part, seq, row, chunk = TaskContext.get().partitionId(), 0, 0, _Chunk()

        def out():
            nonlocal chunk, seq
            n_words, n_tokens, words, texts = chunk.close()
            chunk, seq = _Chunk(), seq + 1
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | seq]), pa.array([n_words]), pa.array([n_tokens]), pa.array([words], pa.binary()), pa.array([texts], pa.binary())], names=["chunk", "n_words", "n_tokens", "words", "texts"]
            )

        for b in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            for doc, raw, train in zip(*(c.to_pylist() for c in b.columns)):
                row, before = row + 1, (b"", b"")
                for words, last in pieces(raw or b""):
                    if words or last:
                        chunk.add(part << 32 | row, doc, train, before, [*words, b""] if last else words)
                        before = (*before, *words[-2:])[-2:]
                    if chunk.size >= CHUNK:
                        yield out()
        if chunk.meta:
            yield out()
        release()

    return df.mapInArrow(run, "chunk bigint, n_words bigint, n_tokens bigint, words binary, texts binary")


def _numbers(chunks: DataFrame, buckets: int) -> DataFrame:
    """(chunk, bucket, blob): numbers and counts of each chunk's words of a bucket; and, where chunk is -1, a bucket's distinct and all training words."""

    def deal(batches):
        for b in batches:
            for chunk, blob in zip(*(c.to_pylist() for c in b.columns)):
                letters, sizes, count, hashed = unpack(blob)
                cuts = np.searchsorted(hashed.astype(np.int64) * buckets >> 32, np.arange(buckets + 1))
                ends = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
                some = [i for i in range(buckets) if cuts[i] < cuts[i + 1]]
                blobs = [pack(letters[ends[cuts[i]] : ends[cuts[i + 1]]], sizes[cuts[i] : cuts[i + 1]], count[cuts[i] : cuts[i + 1]]) for i in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([chunk] * len(some), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "chunk", "blob"])

    def merge(table: pa.Table) -> pa.Table:
        release()
        bucket = table.column("bucket")[0].as_py()
        place: dict[bytes, int] = {}
        parts = []
        for blob in table.column("blob"):
            letters, sizes, count = unpack(blob.as_py())
            parts.append((np.array([place.setdefault(w, len(place)) for w in _words(letters, sizes)], np.int64), count.astype(np.int64)))
        total = np.zeros(len(place), np.int64)
        for at, count in parts:
            total[at] += count  # a chunk has a word once
        known = sorted((w for w, i in place.items() if total[i]), key=lambda w: (-total[place[w]], w))
        number = np.full(len(place), UNKNOWN, np.int64)
        number[[place[w] for w in known]] = FIRST + np.arange(len(known)) * buckets + bucket
        blobs = [pack(narrow(number[at]), narrow(total[at])) for at, _ in parts]
        n = len(parts) + 1
        return pa.table(
            {"chunk": [*table.column("chunk").to_pylist(), -1], "bucket": pa.array([bucket] * n, pa.int32()), "blob": pa.array([*blobs, None], pa.binary()),
             "distinct": [0] * (n - 1) + [len(known)], "total": [0] * (n - 1) + [int(total.sum())]}
        )

    dealt = chunks.select("chunk", "words").mapInArrow(deal, "bucket int, chunk bigint, blob binary")
    return dealt.groupBy("bucket").applyInArrow(merge, "chunk bigint, bucket int, blob binary, distinct bigint, total bigint")


def _mix(x: np.ndarray, by: int) -> np.ndarray:
    h = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(by)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (h ^ (h >> np.uint64(29))) >> np.uint64(1)


def shard_of(v: np.ndarray, u: np.ndarray, count: np.ndarray, tokens: int, shards: int) -> np.ndarray:
    """The shard of triples by the middle word v; count: how often v is followed. A frequent v has a class for each part of the words u before it."""
    classes = 1 + (count * (2.0 * shards / max(1, tokens))).astype(np.uint64)
    which = (_mix(u, 1) % classes).astype(np.int64)
    return ((_mix(v, 2) % np.uint64(shards)).astype(np.int64) + which) % shards


class _Texts:
    """A chunk's texts with the numbers and counts of its words: its triples, and what answers make of them."""

    def __init__(self, texts: bytes, numbers: list[bytes], tokens: int, shards: int):
        tok, self.uid, self.doc, self.null, self.train, u0, v0, n, end = unpack(texts)
        got = [unpack(b) for b in numbers]
        self.number = np.concatenate([[BEFORE], *(g[0].astype(np.int64) for g in got)])
        self.count = np.concatenate([[0], *(g[1].astype(np.int64) for g in got)])
        tok, self.n = tok.astype(np.int64), n.astype(np.int64)
        self.count[0] = self.count[int(end[0])]  # as many texts begin as end
        start = np.cumsum(self.n) - self.n
        v = np.concatenate([[0], tok[:-1]])
        v[start] = v0
        u = np.concatenate([[0], v[:-1]])
        u[start] = u0
        self.tok, self.start = tok, start
        order, rank = np.unique(self.number, return_inverse=True)
        rank = rank.reshape(-1)
        self.asks = self.number[v] != UNKNOWN  # nothing is known of what follows an unknown word
        key = rank[v[self.asks]] << 42 | rank[u[self.asks]] << 21 | rank[tok[self.asks]]
        key, self.back = np.unique(key, return_inverse=True)
        often = np.bincount(self.back, weights=np.repeat(self.train, self.n)[self.asks], minlength=len(key)).astype(np.int64)
        counts = np.zeros(len(order), np.int64)
        counts[rank] = self.count
        v, u, w = key >> 42, key >> 21 & _MASK, key & _MASK
        shard = shard_of(order[v], order[u], counts[v], tokens, shards)
        self.order = np.argsort(shard, kind="stable")
        self.shard = shard[self.order]
        self.v, self.u, self.w, self.often = order[v][self.order], order[u][self.order], order[w][self.order], often[self.order]

    def parts(self):
        """(shard, blob) of the triples that go to each shard: runs of v, in them runs of u, in them w, each as differences."""
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(self.shard)) + 1, [len(self.shard)]]) if len(self.shard) else [0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            v, u, w = self.v[a:b], self.u[a:b], self.w[a:b]
            new_v = np.diff(v, prepend=-1) != 0
            new_u = new_v | (np.diff(u, prepend=-1) != 0)
            at_v, at_u = np.flatnonzero(new_v), np.flatnonzero(new_u)
            step_u = np.where(new_v[at_u], u[at_u], np.diff(u[at_u], prepend=0))
            step_w = np.where(new_u, w, np.diff(w, prepend=0))
            runs = np.diff(np.append(np.flatnonzero(new_v[at_u]), len(at_u)))
            yield int(self.shard[a]), pack(*(narrow(x) for x in (np.diff(v[at_v], prepend=0), runs, step_u, np.diff(np.append(at_u, b - a)), step_w, self.often[a:b])))

    def rows(self, answers: list[bytes], tokens: int, distinct: int) -> pa.RecordBatch:
        """Sums of each text's part, from the codes of the shards in their order."""
        found = [unpack(a) for a in answers]
        share3, rest3, share2, rest2 = (VALUES[np.concatenate(x)] for x in zip(*found)) if found else [np.zeros(0)] * 4
        more, rest = np.zeros(len(self.tok)), np.ones(len(self.tok))
        at = np.empty(len(self.order), np.int64)
        at[self.order] = np.arange(len(self.order))
        at = at[self.back]
        more[self.asks], rest[self.asks] = (share3 + rest3 * share2)[at], (rest3 * rest2)[at]
        count = self.count[self.tok]
        base = (count + 0.5) / (tokens + 0.5 * (distinct + 1))
        add = lambda x: np.add.reduceat(x, self.start)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.uid), pa.array(self.doc, mask=self.null.astype(bool)), pa.array(self.train == 1), pa.array(self.n), pa.array(add((count > 0).astype(np.int64))),
             pa.array(add(np.log10(base))), pa.array(add(np.log10(np.minimum(1.0, more + rest * base))))],
            names=["uid", "doc", "train", "n_tokens", "n_known", "base_score", "score"],
        )


def _unroll(blob: bytes) -> tuple[np.ndarray, ...]:
    """v, u, w and training counts of a blob of triples."""
    step_v, runs, step_u, sizes, step_w, often = (x.astype(np.int64) for x in unpack(blob))

    def summed(steps: np.ndarray, runs: np.ndarray) -> np.ndarray:
        """Sums that begin anew with each run."""
        x, first = np.cumsum(steps), np.cumsum(runs) - runs
        return x - np.repeat(x[first] - steps[first], runs)

    u = summed(step_u, runs)
    v = np.repeat(np.cumsum(step_v), runs)
    return np.repeat(v, sizes), np.repeat(u, sizes), summed(step_w, sizes), often


def _answers(table: pa.Table) -> pa.Table:
    """The codes of each chunk's triples, by the trie of the training counts of all."""
    release()
    blobs = [b.as_py() for b in table.column("blob")]
    parts = [_unroll(b) for b in blobs]
    n = np.cumsum([0] + [len(p[0]) for p in parts])
    v, u, w, often = (np.concatenate(x) for x in zip(*parts))
    del parts, blobs
    train = np.flatnonzero(often)
    trie = Trie.mapped(Trie.build(v[train], u[train], w[train], often[train]))
    codes = trie.probabilities(v, u, w)
    out = [pack(*(c[a:b] for c in codes)) for a, b in zip(n[:-1], n[1:])]
    return pa.table({"chunk": table.column("chunk"), "shard": table.column("shard"), "blob": pa.array(out, pa.binary())})


def score(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score) of each row's whole text, by a model of the training rows.

    Tokens are the runs of other than ``\\x20\\x09-\\x0D`` with A-Z lower-cased, and an end. base_score sums
    log10((c + 0.5) / (N + 0.5 (V + 1))) of a token's training count c, all N training tokens and V distinct ones; n_known
    are the tokens with c > 0. score is the trie's: the chances of a word after two others, after one, and alone,
    interpolated; they sum to 1 over known words and one unknown, up to what 8 bits of a logarithm round.

    Null and empty texts have their end only. train must not be null. Ids may be null or repeat: each row has a result of
    its own. Without training rows every word is unknown. Texts of any length are scored whole. An empty table stays
    empty. Other columns aren't read.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("binary").alias("raw"), train.alias("train"))
    chunks = scratch.save(_chunks(rows), "chunks")
    n_words, n_tokens = (x or 0 for x in chunks.agg(F.sum("n_words"), F.sum("n_tokens")).first())
    buckets, shards = max(LEAST, -(-n_words // WORDS)), shards or max(LEAST, -(-n_tokens // TOKENS))
    numbers = scratch.save(_numbers(chunks, buckets), "numbers")
    distinct, tokens = (x or 0 for x in numbers.where("chunk = -1").agg(F.sum("distinct"), F.sum("total")).first())
    known = chunks.select("chunk", F.lit(-1).alias("bucket"), F.col("texts").alias("blob")).union(numbers.where("chunk >= 0").select("chunk", "bucket", "blob")).groupBy("chunk")

    def texts(table: pa.Table) -> _Texts:
        order = np.argsort(table.column("bucket").to_numpy())
        blobs = [table.column("blob")[i].as_py() for i in order.tolist()]
        return _Texts(blobs[0], blobs[1:], tokens, shards)

    def ask(table: pa.Table) -> pa.Table:
        release()
        parts = list(texts(table).parts())
        chunk = table.column("chunk")[0].as_py()
        return pa.table({"shard": pa.array([p[0] for p in parts], pa.int32()), "chunk": pa.array([chunk] * len(parts), pa.int64()), "blob": pa.array([p[1] for p in parts], pa.binary())})

    def close(table: pa.Table, answers: pa.Table) -> pa.Table:
        release()
        order = np.argsort(answers.column("shard").to_numpy())
        return pa.Table.from_batches([texts(table).rows([answers.column("blob")[i].as_py() for i in order.tolist()], tokens, distinct)])

    asked = known.applyInArrow(ask, "shard int, chunk bigint, blob binary")
    told = asked.groupBy("shard").applyInArrow(_answers, "chunk bigint, shard int, blob binary")
    sums = known.cogroup(told.groupBy("chunk")).applyInArrow(close, "uid bigint, doc bigint, train boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    each = sums.groupBy("uid").agg(F.max("doc").alias(id_col), F.max("train").alias("train"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return each.select(id_col, "train", "n_tokens", "n_known", F.lit(int(tokens)).cast("bigint").alias("train_tokens"), "base_score", "score")


def op11_lm_score(spark, sf_dir: str) -> DataFrame:
    """Scores of every document by a model of those whose CRC-32 of the id modulo 5 isn't 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    scored = score(docs, ~held)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
