"""Nearest neighbours by largest inner product, over additively quantised vectors.

1. Codebooks are full-dimensional and are fitted one after another on what the earlier ones leave of a bounded sample;
   a least-squares pass over all of them then corrects each for the others.
2. Every distinct vector is encoded by beam search: partial sums of one codeword a book, the best few kept at each
   book. Its codes and the norm of what they miss are stored.
3. A query has a table of its inner products with all codewords. A row's estimate is the sum of one entry a book.
   Blocks of queries meet blocks of rows. The exact products of the ``SHORT`` best estimates give a product to reach.
4. No row's product is above its estimate + |query| * norm of what its codes miss. Every row that can reach the product by
   this bound is ranked exactly, so codes decide what a search costs and never what it finds. A block reports its best
   with ties, and the best of all blocks are ranked by the product of the original vectors.

Equal vectors are indexed once and stand for
their smallest ids, as many as a result can need. Copies of a vector are thus neither scored nor shipped twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewise.llm import scratch
from tilewise.llm.vectors import matrix, takes_part

#: Vectors that codebooks are fitted on (expected number), books, codewords of a book, beam, rounds of k-means, steps of the least squares.
SAMPLE, BOOKS, WORDS, BEAM, ROUNDS, STEPS = 20_000, 16, 256, 4, 6, 8
#: Best estimates of a query that set what a row must reach, queries of a block, rows of a block. Relative room for rounding of
#: estimates (single precision) and of products.
SHORT, QUERIES, ROWS, LOOSE, FINE = 512, 1 << 13, 1 << 17, 1e-5, 1e-12


class Codebooks:
    """Additive quantiser. books: (BOOKS, WORDS, dim)."""

    def __init__(self, books: np.ndarray):
        self.books = books
        m, k, d = books.shape
        self.flat = books.reshape(m * k, d)
        self.gram = (self.flat.astype(np.float32) @ self.flat.T.astype(np.float32))
        self.norm = (self.flat**2).sum(1)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes (uint8) by beam search, and the norm of what they miss."""
        m, k, _ = self.books.shape
        codes, missed = np.zeros((len(x), m), np.uint8), np.zeros(len(x))
        for lo in range(0, len(x), 256):
            y = x[lo : lo + 256]
            n = len(y)
            dots = (y @ self.flat.T).reshape(n, m, k)
            cost = np.zeros((n, 1))  # |sum|^2 - 2 <x, sum>
            picks = np.zeros((n, 1, 0), np.int64)
            for j in range(m):
                step = self.norm[j * k : (j + 1) * k][None, None, :] - 2 * dots[:, j][:, None, :]
                cross = np.zeros((n, picks.shape[1], k))
                for i in range(j):
                    cross += self.gram[picks[:, :, i] + i * k, j * k : (j + 1) * k]
                total = (cost[:, :, None] + step + 2 * cross).reshape(n, -1)
                keep = min(beam, total.shape[1])
                best = np.argpartition(total, keep - 1, axis=1)[:, :keep]
                best = np.take_along_axis(best, np.argsort(np.take_along_axis(total, best, 1), axis=1, kind="stable"), 1)
                cost = np.take_along_axis(total, best, 1)
                picks = np.concatenate([np.take_along_axis(picks, (best // k)[:, :, None], 1), (best % k)[:, :, None]], 2)
            codes[lo : lo + n] = picks[:, 0]
            missed[lo : lo + n] = np.linalg.norm(y - sum(self.books[j][picks[:, 0, j]] for j in range(m)), axis=1)
        return codes, missed

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of each query with each codeword: (queries, BOOKS, WORDS), single precision."""
        return (q @ self.flat.T).astype(np.float32).reshape(len(q), *self.books.shape[:2])


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS, seed: int = 0) -> Codebooks:
    """Codebooks of a sample, the same for the same rows in the same order. Few rows give few different codewords."""
    rng, rest, out = np.random.default_rng(seed), x.copy(), np.zeros((books, words, x.shape[1]))
    picked = np.zeros((len(x), books), np.int64)
    for b in range(books):
        if len(x):
            c = rest[rng.permutation(len(x))[:words]] if len(x) >= words else rest[np.arange(words) % len(x)]
            for _ in range(rounds):
                at = np.argmin((c**2).sum(1)[None, :] - 2 * rest @ c.T, axis=1)
                n = np.bincount(at, minlength=words)
                order = np.argsort(at, kind="stable")
                first = np.flatnonzero(np.diff(at[order], prepend=-1))
                total = np.zeros_like(c)
                total[at[order][first]] = np.add.reduceat(rest[order], first, axis=0)
                c = np.where(n[:, None] > 0, total / np.maximum(1, n)[:, None], c)
            picked[:, b] = np.argmin((c**2).sum(1)[None, :] - 2 * rest @ c.T, axis=1)
            rest = rest - c[picked[:, b]]
            out[b] = c
    if len(x) > books * words:  # all books anew for the codes that beam search gives, towards the least squares
        codes, _ = Codebooks(out).encode(x)
        on = codes.astype(np.int64) + np.arange(books) * words
        flat = out.reshape(books * words, -1)
        gather = lambda w: sum(w[on[:, b]] for b in range(books))

        def spread(r):
            total = np.zeros_like(flat)
            for b in range(books):
                order = np.argsort(on[:, b], kind="stable")
                at = on[order, b]
                first = np.flatnonzero(np.diff(at, prepend=-1))
                total[at[first]] = np.add.reduceat(r[order], first, axis=0)
            return total

        # Conjugate gradients on the normal equations, each dimension by itself; a little ridge keeps unused words.
        residual = spread(x - gather(flat))
        move, size = residual.copy(), (residual**2).sum(0)
        for _ in range(STEPS):
            image = spread(gather(move)) + move
            step = size / np.maximum(1e-300, (move * image).sum(0))
            flat = flat + step * move
            residual = residual - step * image
            size, before = (residual**2).sum(0), size
            move = residual + size / np.maximum(1e-300, before) * move
        out = flat.reshape(out.shape)
    return Codebooks(out)


def search(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, short: int = SHORT, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries the k rows of df with largest inner product, nearest first.

    queries has the columns id_col and vec_col. A query isn't its own neighbour: rows of its id are left out. Ties go to
    the smaller id; fewer candidates than k give fewer rows. Vectors that are null, all zeros, or hold null or
    non-finite components, and rows with a null id take no part on either side. Unequal lengths: as if filled with
    zeros. Repeated rows count once. Scores are sums of double products in the order of the components.
    """
    spark = df.sparkSession

    def rows(d):
        return d.where(takes_part(vec_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.transform(vec_col, lambda x: x.cast("double") + 0.0).alias("vec"))

    # A result needs no more than k + 1 of a vector's ids: the smallest, as one may be the query's own.
    order = Window.partitionBy("vec").orderBy("id")
    few = rows(df).withColumn("at", F.dense_rank().over(order)).where(F.col("at") <= k + 1)
    index = scratch.save(few.groupBy("vec").agg(F.array_sort(F.collect_set("id")).alias("ids")).select("vec", "ids", F.col("ids")[0].alias("rep")), "index")
    asked = scratch.save(rows(queries).dropDuplicates(["id"]), "queries")
    n, dim = index.agg(F.count("*"), F.max(F.size("vec"))).first()
    m, dim_q = asked.agg(F.count("*"), F.max(F.size("vec"))).first()
    dim = max(dim or 1, dim_q or 1)
    share = min(1.0, sample / max(1, n))
    drawn = index.where(F.shiftrightunsigned(F.xxhash64("rep", F.lit("books")), 11) * F.lit(2.0**-53) < share).select("vec", "rep").toArrow().sort_by("rep")
    books = spark.sparkContext.broadcast(fit(matrix(drawn.column("vec"), dim)).books)
    row_blocks, query_blocks = max(12, -(-n // ROWS)), max(1, -(-m // QUERIES))

    def encode(batches):
        c = Codebooks(books.value)
        for b in batches:
            codes, missed = c.encode(matrix(b.column(0), dim))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(list(map(bytes, codes)), pa.binary()), pa.array(missed), b.column(0)], names=["rep", "code", "missed", "vec"])

    coded = scratch.save(index.select("vec", "rep").mapInArrow(encode, "rep bigint, code binary, missed double, vec array<double>"), "codes")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = coded.select(F.pmod(F.xxhash64("rep"), F.lit(row_blocks)).cast("int").alias("r"), every(query_blocks).alias("q"), "rep", "code", "missed", "vec")
    right = asked.select(every(row_blocks).alias("r"), F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int").alias("q"), F.col("id").alias("rep"), F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("missed"), "vec")

    none = pa.table({"query_id": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "s": pa.array([], pa.float64()), "room": pa.array([], pa.float64())})

    def score(table: pa.Table) -> pa.Table:
        is_row = np.asarray(table.column("code").is_valid())
        rows, ask = table.filter(pa.array(is_row)), table.filter(pa.array(~is_row))
        if not rows.num_rows or not ask.num_rows:
            return none
        rep = rows.column("rep").to_numpy()
        order = np.argsort(rep)
        rep = rep[order]
        c = Codebooks.__new__(Codebooks)
        c.books = books.value
        c.flat = c.books.reshape(-1, dim)
        codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(rep), -1)[order].T.astype(np.intp)
        x, missed = matrix(rows.column("vec"), dim)[order], rows.column("missed").to_numpy()[order]
        q, ids = matrix(ask.column("vec"), dim), ask.column("rep").to_numpy()
        longest = np.sqrt((x**2).sum(1).max()) + np.sqrt((c.flat**2).sum(1).reshape(len(codes), -1).max(1)).sum()
        out_q, out_r, out_s, out_e = [], [], [], []
        for i in range(len(ids)):
            table = c.tables(q[i : i + 1])[0]
            size = np.linalg.norm(q[i])
            s = table[0].take(codes[0])
            for j in range(1, len(codes)):
                s += table[j].take(codes[j])
            room = FINE * size * longest * dim
            at = np.arange(len(s))
            if len(s) > max(short, k + 1):  # k + 1, as one can be the query itself
                first = np.argpartition(-s, max(short, k + 1) - 1)[: max(short, k + 1)]
                reach = np.partition(x[first] @ q[i], -(k + 1))[-(k + 1)] - room
                at = np.flatnonzero(~(s + size * (missed + LOOSE * longest) < reach))
            exact = x[at] @ q[i]
            if len(at) > k + 1:
                best = ~(exact < np.partition(exact, -(k + 1))[-(k + 1)] - room)
                at, exact = at[best], exact[best]
            out_q.append(np.full(len(at), ids[i]))
            out_r.append(rep[at])
            out_s.append(exact)
            out_e.append(np.full(len(at), room))
        flat = lambda x, kind: pa.array(np.concatenate(x) if x else [], kind)
        return pa.table({"query_id": flat(out_q, pa.int64()), "rep": flat(out_r, pa.int64()), "s": flat(out_s, pa.float64()), "room": flat(out_e, pa.float64())})

    found = left.union(right).groupBy("r", "q").applyInArrow(score, "query_id bigint, rep bigint, s double, room double")
    best = Window.partitionBy("query_id").orderBy(F.col("s").desc(), "rep")
    least = F.max(F.when(F.col("at") == k + 1, F.col("s"))).over(Window.partitionBy("query_id"))
    ranked = found.withColumn("at", F.row_number().over(best)).withColumn("least", least)
    short_list = ranked.where(F.col("least").isNull() | (F.col("s") >= F.col("least") - F.col("room"))).select("query_id", "rep")
    full = short_list.join(index, "rep").join(asked.select(F.col("id").alias("query_id"), F.col("vec").alias("q")), "query_id")
    product = F.aggregate(F.zip_with("vec", "q", lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda acc, x: acc + x)
    near = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    each = full.select("query_id", product.alias("score"), F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    return each.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_ann(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every embedding whose vec_id is divisible by 20."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(rows, rows.where("vec_id % 20 = 0"))
