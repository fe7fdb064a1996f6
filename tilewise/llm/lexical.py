"""Ranked lexical search: a blocked sparse matrix product of items by terms with terms by documents.

Documents become blocks of a sparse matrix: of each term that some item has, the documents that hold it and how often.
These blocks are written once; they give the numbers of documents that weights need, and then the product. An item's row
of it is merged from the rows of its terms (Gustavson, 1978), in 64-bit integers: a row is scattered into one
accumulator a document. Each task keeps an item's best documents over its blocks, and what tasks report is reduced twice.

Items come in blocks of about ``PAIRS`` pairs of an item and a term; a block is broadcast with its terms and weights, and is
a pass over the documents. Nothing that grows with the documents leaves the executors but counts for a block's terms.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from tilewise.llm import scratch
from tilewise.llm.arrays import narrow, pack, unpack
from tilewise.llm.memory import release

#: Results an item, pairs of items and terms in a block, documents and terms of a block of the matrix, bytes read at once, groups of tasks.
BEST, PAIRS, DOCS, TERMS, PIECE, SPREAD = 10, 1 << 20, 4096, 1 << 21, 1 << 20, 64
#: Fixed values of the ranking: a term is a run of digits, letters and all beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(c + 32 if 65 <= c < 91 else c if 48 <= c < 58 or 97 <= c < 123 or c > 127 else 32 for c in range(256))


def terms(raw: bytes):
    """Lists of the terms of a text in UTF-8, about ``PIECE`` bytes at a time."""
    raw, at = raw.translate(_TABLE), 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE) if len(raw) - at > PIECE else -1
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def weight(n_docs: int, df: int) -> int:
    """A term's weight, in thousandths, from the documents that there are and that hold it."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def lengths(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a document's length adds below a term's count: 10 and 90 parts of its terms to the mean."""
    if len(n) and 90 * int(n.max()) * n_docs >= 1 << 63:
        return np.array([10 + 90 * int(x) * n_docs // n_terms for x in n], np.int64)
    return 10 + 90 * n * n_docs // max(1, n_terms)


def impacts(weights: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What occurrences of terms add to scores; all are 64-bit integers."""
    return weights * (1_000_000_000 * tf // (1000 * tf + 8 * m))


class Block:
    """Documents by terms: the documents' ids and sizes, and for each term, in order, where it is and how often."""

    def __init__(self, blob: bytes):
        self.ids, self.null, self.n, self.terms, self.count, docs, tf = unpack(blob)
        self.n, self.docs, self.tf = self.n.astype(np.int64), docs.astype(np.int64), tf.astype(np.int64)
        self.ptr = np.concatenate([[0], np.cumsum(self.count.astype(np.int64))])


def _matrix(docs: DataFrame, id_col: str, text_col: str, vocabulary) -> DataFrame:
    """(docs, terms, blob) of blocks of documents: how many have a term, how many terms these have, and the block."""

    def run(batches):
        release()
        get = {t: i for i, t in enumerate(vocabulary.value)}.get
        ids, sizes, owners, found, held = [], [], [], [], 0

        def close():
            nonlocal ids, sizes, owners, found, held
            where, what = np.repeat(np.arange(len(ids)), [len(f) for f in found]), np.concatenate(found) if found else np.zeros(0, np.int64)
            cell, tf = np.unique(what.astype(np.int64) * max(1, len(ids)) + where, return_counts=True)
            term, doc = cell // max(1, len(ids)), cell % max(1, len(ids))
            first = np.flatnonzero(np.diff(term, prepend=-1))
            n = np.array(sizes, np.int64)
            blob = pack(
                np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids], np.uint8), narrow(n), narrow(term[first]),
                narrow(np.diff(np.append(first, len(term)))), narrow(doc), narrow(tf),
            )
            out = pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64()), pa.array([blob], pa.binary())], names=["docs", "terms", "blob"])
            ids, sizes, owners, found, held = [], [], [], [], 0
            return out

        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, hits = 0, [np.zeros(0, np.int32)]
                for words in terms(raw or b""):
                    n += len(words)
                    at = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
                    hits.append(at[at >= 0])
                ids.append(doc)
                sizes.append(n)
                found.append(np.concatenate(hits))
                held += n
                if len(ids) == DOCS or held >= TERMS:
                    yield close()
        if ids:
            yield close()
        release()

    rows = docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("binary"))
    return rows.mapInArrow(run, "docs bigint, terms bigint, blob binary")


def _frequencies(matrix: DataFrame, size: int) -> list:
    """(term, documents that hold it), summed in each task before they are shuffled."""

    def run(batches):
        df = np.zeros(size, np.int64)
        for b in batches:
            for blob in b.column(0).to_pylist():
                block = Block(blob)
                df[block.terms] += block.count
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["term", "df"])

    return matrix.select("blob").mapInArrow(run, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect()


class _Best:
    """An item's best documents so far: highest score, then smallest id, null last."""

    __slots__ = ("scores", "ids", "null")

    def __init__(self):
        self.scores, self.ids, self.null = (np.zeros(0, t) for t in (np.int64, np.int64, np.uint8))

    def least(self, k: int) -> int:
        return int(self.scores[-1]) if len(self.scores) == k else 1

    def add(self, scores, ids, null, k: int) -> None:
        scores, ids, null = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.null, null)))
        order = np.lexsort((ids, null, -scores))[:k]
        self.scores, self.ids, self.null = scores[order], ids[order], null[order]


def _product(matrix: DataFrame, shared, k: int, kind: StructType) -> DataFrame:
    """(item, doc_id, score, task): each task's k best documents of each item. shared: items, their terms, weights and totals."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def run(batches):
        from pyspark import TaskContext

        release()
        items, ptr, cols, times, weights, n_docs, n_terms = shared.value
        best = [_Best() for _ in items]
        for b in batches:
            for blob in b.column(0).to_pylist():
                block = Block(blob)
                slot = np.full(len(weights), -1, np.int64)
                slot[block.terms] = np.arange(len(block.terms))
                worth = impacts(np.repeat(weights[block.terms], block.count), block.tf, lengths(block.n, n_docs, n_terms)[block.docs])
                total = np.zeros(len(block.ids), np.int64)
                for i, (lo, hi) in enumerate(zip(ptr[:-1], ptr[1:])):
                    rows = slot[cols[lo:hi]]
                    for r, often in zip(rows[rows >= 0].tolist(), times[lo:hi][rows >= 0].tolist()):
                        row = slice(block.ptr[r], block.ptr[r + 1])
                        total[block.docs[row]] += worth[row] * often  # a document is once in a term's row
                    hit = np.flatnonzero(total >= best[i].least(k))
                    if len(hit) > k:
                        hit = hit[total[hit] >= np.partition(total[hit], -k)[-k]]
                    if len(hit):
                        best[i].add(total[hit], block.ids[hit], block.null[hit], k)
                    total[:] = 0
        n = [len(x.scores) for x in best]
        task = TaskContext.get().partitionId() % SPREAD
        at = np.repeat(np.arange(len(items)), n)
        ids, null, scores = (np.concatenate([getattr(x, f) for x in best]) if best else np.zeros(0, np.int64) for f in ("ids", "null", "scores"))
        for lo in range(0, len(at), 1 << 16):
            some = slice(lo, lo + (1 << 16))
            yield pa.RecordBatch.from_arrays(
                [pa.array([items[j] for j in at[some].tolist()], arrow.field(0).type), pa.array(ids[some], mask=null[some].astype(bool)), pa.array(scores[some]), pa.array(np.full(len(at[some]), task, np.int32))], schema=arrow
            )
        release()

    return matrix.select("blob").mapInArrow(run, kind)


def search(docs: DataFrame, items: DataFrame, k: int = BEST, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", once: bool = True, pairs: int = PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 of each item, ties by smaller doc_id.

    A text's terms are the runs of digits, letters and characters beyond ASCII, A-Z lower-cased. N documents have a
    term, L terms in all; a term in df of them weighs w = floor(1000 ln((2N + 2) / (2df + 1))). A document with n terms
    has m = 10 + 90nN div L and scores the sum of w * (10^9 tf div (1000 tf + 8m)) over the item's terms, each once or,
    with once=False, as often as the item has it.

    Null texts have no terms; an item without terms, or without a document that scores, has no rows. Rows that share an
    item_id, null included, are one item with the terms of all. Rows that share a doc_id are documents of their own; a
    null doc_id comes after others of its score. Texts are whole, however long. Empty tables give no rows. Other columns
    aren't read.
    """
    spark = docs.sparkSession
    said = F.regexp_extract_all(F.translate(F.coalesce(F.col(item_text_col), F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))
    wanted = items.select(F.col(item_col).alias("item"), F.explode(said).alias("term")).groupBy("item", "term").agg(F.count("*").alias("often"))
    wanted = scratch.save(wanted.groupBy("item").agg(F.collect_list(F.struct("term", "often")).alias("terms")), "items")
    blocks = max(1, -(-(wanted.agg(F.sum(F.size("terms"))).first()[0] or 0) // pairs))
    kind = StructType([StructField("item", wanted.schema["item"].dataType), StructField("doc_id", LongType()), StructField("score", LongType()), StructField("task", IntegerType())])
    reports = []
    for b in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()  # about ``pairs`` of items and terms
        words = sorted({t.term for r in rows for t in r.terms})
        place = {w: i for i, w in enumerate(words)}
        vocabulary = spark.sparkContext.broadcast([w.encode("utf-8", "surrogatepass") for w in words])
        matrix = scratch.save(_matrix(docs, doc_col, text_col, vocabulary), "matrix")
        n_docs, n_terms = (x or 0 for x in matrix.agg(F.sum("docs"), F.sum("terms")).first())
        weights = np.zeros(len(words), np.int64)
        for r in _frequencies(matrix, len(words)):
            weights[r.term] = weight(n_docs, r.df)
        ptr = np.cumsum([0] + [len(r.terms) for r in rows])
        cols = np.array([place[t.term] for r in rows for t in r.terms], np.int64)
        times = np.array([1 if once else t.often for r in rows for t in r.terms], np.int64)
        shared = spark.sparkContext.broadcast(([r["item"] for r in rows], ptr, cols, times, weights, n_docs, n_terms))
        reports.append(_product(matrix, shared, k, kind))
    found = reports[0]
    for r in reports[1:]:
        found = found.union(r)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    found = found.withColumn("rank", rank("item", "task")).where(F.col("rank") <= k)
    found = found.withColumn("rank", rank("item")).where(F.col("rank") <= k)
    return found.select(F.col("item").alias("item_id"), "rank", "doc_id", "score")


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


_SAID = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')"

OP12_SQL = f"""
    WITH said AS (SELECT doc_id, {_SAID} AS ts FROM documents), sized AS (SELECT doc_id, CAST(len(ts) AS BIGINT) AS n, ts FROM said WHERE len(ts) > 0),
    total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sized), held AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, n, unnest(ts) AS t FROM sized) GROUP BY ALL),
    asked AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest({_SAID}) AS t FROM benchmark)),
    weighed AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, total WHERE t IN (SELECT t FROM asked) GROUP BY t, docs),
    scored AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
               FROM asked JOIN weighed USING (t) JOIN held USING (t), total GROUP BY item_id, doc_id),
    ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {BEST}
"""
