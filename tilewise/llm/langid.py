"""Language identification with spans of mixed-language text.

A word is a run of letters and marks. Its script (by ranges of code points) leaves as candidates the languages that use
that script in the training texts; each gets the sum of its log probabilities of the word's letter trigrams, borders
included. Viterbi over a text's words, with a penalty for a switch of language, labels spans. The text's language is
the one with most letters; the score is its share of the letters.

The model is a table of hashed trigrams by language, from a bounded sample of labelled texts; its size is fixed by the
number of languages, so it is collected and broadcast. Texts are scored whole, in blocks, without a shuffle.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewise.llm import scratch
from tilewise.llm.memory import release

#: Training texts a language (expected number), hashed trigrams, what a count is raised by, the penalty of a switch,
#: the share of a language's letters from which a script counts as its own, the cost of a word in another script.
SAMPLE, BUCKETS, RAISE, SWITCH, OWN_SCRIPT, FOREIGN = 2000, 1 << 16, 0.05, 12.0, 0.01, 25.0
#: Characters scored at once; (word, language) cells of Viterbi kept at once; rows labelled at once.
BLOCK, CELLS, ROWS = 1 << 20, 1 << 23, 1024
#: Training texts that a task counts, about.
TEXTS = 1500
#: Characters of the texts that are labelled together: Viterbi takes a step for each word of the longest.
GROUP = 4 << 20
#: First code point of each range, and its script (0: none or any other).
RANGES = (
    (0x0000, 0), (0x0041, 1), (0x0250, 0), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0700, 0),
    (0x0750, 6), (0x0780, 0), (0x0900, 7), (0x0980, 8), (0x0A00, 9), (0x0A80, 10), (0x0B00, 0), (0x0B80, 11), (0x0C00, 12),
    (0x0C80, 13), (0x0D00, 14), (0x0D80, 15), (0x0E00, 16), (0x0E80, 17), (0x0F00, 18), (0x1000, 19), (0x10A0, 20),
    (0x1100, 21), (0x1200, 22), (0x13A0, 0), (0x1780, 23), (0x1800, 24), (0x18B0, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0),
    (0x3040, 25), (0x3100, 0), (0x3130, 21), (0x3190, 0), (0x31F0, 25), (0x3200, 0), (0x3400, 26), (0xA000, 0), (0xAC00, 21),
    (0xD7B0, 0), (0xF900, 26), (0xFB00, 1), (0xFB13, 4), (0xFB1D, 5), (0xFB50, 6), (0xFE00, 0), (0xFF21, 1), (0xFF66, 25),
    (0xFFA0, 21), (0xFFE0, 0), (0x20000, 26), (0x323B0, 0),
)
SCRIPTS = 27
_tables: dict[str, np.ndarray] = {}


def _chars() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: 2 for a letter, 1 for a mark; the lower-case letter; the script."""
    if not _tables:
        kind, low = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
        for i in range(0x32400):
            c = unicodedata.category(chr(i))[0]
            if c == "L":
                kind[i] = 2
                x = chr(i).lower()
                low[i] = ord(x) if len(x) == 1 else i
            elif c == "M":
                kind[i] = 1
        first = np.array([r[0] for r in RANGES])
        script = np.array([r[1] for r in RANGES], np.uint8)[np.searchsorted(first, np.arange(0x110000), side="right") - 1]
        _tables.update(kind=kind, low=low, script=script)
    return _tables["kind"], _tables["low"], _tables["script"]


def _grams(text: str):
    """Of a block of text: for each letter or mark its trigram's bucket; of each word its first character, length in letters and script."""
    kind, low, script = _chars()
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    on = kind[code]
    c = np.zeros(len(code) + 2, np.uint32)
    c[1:-1] = np.where(on > 0, low[code], 0)
    at = np.flatnonzero(on)
    h = c[at] * np.uint32(0x9E3779B1) ^ c[at + 1] * np.uint32(0x85EBCA77) ^ c[at + 2] * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    letters = np.add.reduceat((on[at] == 2).astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    end = np.append(first[1:], len(at)) if len(first) else first
    return (h >> np.uint32(16)) % np.uint32(BUCKETS), first, at[first], at[end - 1] + 1 if len(first) else first, letters, script[code[at[first]]]


def _pieces(text: str) -> Iterable[tuple[int, str]]:
    """Parts of a text that end outside of words, with their places; a word longer than a block is a part of its own."""
    kind, at = _chars()[0], 0
    while len(text) - at > BLOCK:
        end = at + BLOCK
        while end > at and kind[ord(text[end])]:
            end -= 1
        if end == at:
            end = at + BLOCK
            while end < len(text) and kind[ord(text[end])]:
                end += 1
        yield at, text[at:end]
        at = end
    yield at, text[at:]


class Model:
    """counts: trigrams by language and bucket; scripts: letters by language and script."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        p = np.log((counts + RAISE) / (counts.sum(1, keepdims=True) + RAISE * BUCKETS)).T
        self.table = np.ascontiguousarray((p - p.max(1, keepdims=True)).astype(np.float32)) if langs else np.zeros((BUCKETS, 0), np.float32)
        own = scripts >= OWN_SCRIPT * np.maximum(1, scripts.sum(1, keepdims=True))
        self.bar = np.where(own.T | ~own.any(0)[:, None], 0.0, -FOREIGN).astype(np.float32)

    def words(self, text: str):
        """Scores by language, first and last+1 character, and letters of each word of a text."""
        h, first, start, end, letters, script = _grams(text)
        if not len(first):
            return np.zeros((0, len(self.langs)), np.float32), start, end, letters
        return np.add.reduceat(self.table[h], first, axis=0) + self.bar[script], start, end, letters

    def paths(self, scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The language of each word by Viterbi; scores: the words of several texts in turn; sizes: words a text."""
        out = np.zeros(len(scores), np.int16)
        head, order = np.cumsum(sizes) - sizes, np.argsort(-sizes, kind="stable")
        lo = 0
        while lo < len(order) and sizes[order[lo]]:
            steps = int(sizes[order[lo]])
            group = order[lo : lo + max(1, CELLS // (steps * max(1, len(self.langs))))]
            group = group[sizes[group] > 0]
            group = group[: max(1, int(np.searchsorted(-sizes[group], -(steps // 2), side="right")))]
            lo += len(group)
            n = np.searchsorted(-sizes[group], -np.arange(steps), side="left")  # texts that have a word t
            turn, best = np.zeros((steps, len(group), len(self.langs)), bool), np.zeros((steps, len(group)), np.int16)
            v = scores[head[group]].astype(np.float64)
            for t in range(1, steps):
                k = n[t]
                x = v[:k]
                b = x.argmax(1)
                best[t, :k] = b
                top = x[np.arange(k), b][:, None] - SWITCH
                np.less(x, top, out=turn[t, :k])
                np.maximum(x, top, out=x)
                x += scores[head[group[:k]] + t]
            now = v.argmax(1).astype(np.int16)
            for t in range(steps - 1, -1, -1):
                k = n[t]
                out[head[group[:k]] + t] = now[:k]
                if t:
                    now[:k] = np.where(turn[t, np.arange(k), now[:k]], best[t, :k], now[:k])
        return out

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """(language, score, spans (first character, last + 1, language)) of each text."""
        parts: list[tuple] = []
        held: list[tuple[int, int, str]] = []
        size = 0

        def flush():
            nonlocal held, size
            if held:
                s, a, e, n = self.words("\n".join(x[2] for x in held))
                place = np.cumsum([0] + [len(x[2]) + 1 for x in held])
                which = np.searchsorted(place, a, side="right") - 1
                shift = np.array([x[1] for x in held]) - place[:-1]
                parts.append((np.array([x[0] for x in held])[which], s, a + shift[which], e + shift[which], n))
            held, size = [], 0

        for i, text in enumerate(texts):
            for at, piece in _pieces(text or ""):
                held.append((i, at, piece))
                size += len(piece)
                if size >= BLOCK:
                    flush()
        flush()
        doc, score, start, end, letters = (np.concatenate(x) for x in zip(*parts))
        path = self.paths(score, np.bincount(doc, minlength=len(texts))) if self.langs else np.zeros(len(doc), np.int16)
        weight = np.bincount(doc * max(1, len(self.langs)) + path, letters, len(texts) * max(1, len(self.langs))).reshape(len(texts), -1)
        new = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(path, prepend=-1) != 0))
        last = np.append(new[1:], len(doc))[: len(new)] - 1
        spans: list[list] = [[] for _ in texts]
        if self.langs:
            for d, a, e, l in zip(doc[new].tolist(), start[new].tolist(), end[last].tolist(), path[new].tolist()):
                spans[d].append((a, e, self.langs[l]))
        total, top = weight.sum(1), weight.argmax(1)
        return [(self.langs[top[i]], float(weight[i, top[i]] / total[i]), spans[i]) if total[i] and self.langs else ("und", 0.0, []) for i in range(len(texts))]


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model of the languages in lang_col, from about ``sample`` texts of each, chosen by a hash of the id.

    Rows without text or language teach nothing. What goes to the driver is a table of fixed size for each language.
    """
    good = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in good.groupBy(lang_col).count().collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((0, BUCKETS)), np.zeros((0, SCRIPTS)))
    share = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample / counts[k]))]), F.col(lang_col))
    drawn = F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")), 11) * F.lit(2.0**-53) < share
    place = {k: i for i, k in enumerate(langs)}

    def count(batches):
        release()
        grams, scripts = np.zeros((len(langs), BUCKETS), np.int64), np.zeros((len(langs), SCRIPTS), np.int64)
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for _, piece in _pieces(text):
                    h, first, _, _, letters, script = _grams(piece)
                    grams[place[lang]] += np.bincount(h, minlength=BUCKETS)
                    scripts[place[lang]] += np.bincount(script, letters, SCRIPTS).astype(np.int64)
        for i in range(len(langs)):
            if grams[i].any():
                blob = zstandard.compress(grams[i].tobytes() + scripts[i].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([blob], pa.binary())], names=["lang", "blob"])

    grams, scripts = np.zeros((len(langs), BUCKETS)), np.zeros((len(langs), SCRIPTS))
    for r in good.where(drawn).select(text_col, lang_col).repartition(max(1, -(-len(langs) * sample // TEXTS))).mapInArrow(count, "lang int, blob binary").collect():
        x = np.frombuffer(zstandard.decompress(bytes(r["blob"])), np.int64)
        grams[r["lang"]] += x[:BUCKETS]
        scripts[r["lang"]] += x[BUCKETS:]
    return Model(langs, grams, scripts)


def predict(df: DataFrame, model: Model, text_col: str = "text", spans: bool = False, lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """df with the language and score of each whole text, and with its spans if asked for; columns of these names are replaced.

    Null texts and texts without a letter, and every text if the model knows no language, are ``und`` with score 0 and
    no spans. Equal texts get equal results. Other columns pass through. An empty table stays empty.
    """
    shared = df.sparkSession.sparkContext.broadcast((model.langs, model.table, model.bar))
    made = {lang_out: "string", score_out: "double"} | ({"spans": "array<struct<start:int,end:int,lang:string>>"} if spans else {})
    rest, own = scratch.others(df, made), scratch.prefix(df)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches):
        release()
        m = Model.__new__(Model)
        m.langs, m.table, m.bar = shared.value
        b = text = done = new = None
        for b in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            text, done = b.column(len(rest)).to_pylist(), []
            lo = size = 0
            for i, t in enumerate(text):
                size += len(t or "")
                if size > GROUP or i == len(text) - 1:
                    done += m.label(text[lo : i + 1])
                    lo, size = i + 1, 0
            new = [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.float64())]
            if spans:
                new.append(pa.array([[dict(zip(("start", "end", "lang"), s)) for s in d[2]] for d in done], span))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], *new], names=[*rest, *made])
        del text, done, new, b
        release()

    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    schema = StructType([df.schema[c] for c in rest] + [StructField(k, _parse_datatype_string(t)) for k, t in made.items()])
    return df.select(*[f"`{c}`" for c in rest], F.col(text_col).alias(f"{own}text")).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from training: CRC-32 of its id as text, modulo 4, is 2. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op10_langid(spark, sf_dir: str) -> DataFrame:
    """The language of every document, by a model of the documents that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    model = fit(docs.where(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
