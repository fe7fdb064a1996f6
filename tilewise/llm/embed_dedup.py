"""Near-duplicates among embeddings by tiled comparison in PCA order.

1. Equal vectors are one row with a count. Vectors are scaled to length 1 and turned into the axes of their second
   moments (sums over all rows), so the first dimensions hold most of a product.
2. Rows go to tiles: a k-d tree over the leading axes, its cuts from a bounded sample, then hashed parts of leaves that
   hold more than a tile's rows. A tile has as many rows as ``TILE`` bytes hold, or an eighth of all where these are
   few, so a row is dealt to 8 tiles at most while 8 tiles hold the table, and then to one more for each tile that the
   table grows by and that may link with the row's. A tile has a centre and a radius; these are broadcast, and there are
   about ``TILES`` of them at most.
3. Two tiles meet unless their centres are too far apart for any link. A task compares them block by block: products of
   the leading dimensions first; what remains of a product is at most the product of the suffix norms; pairs that can't
   reach the threshold are dropped, and only the rest is carried to further dimensions.
4. Products within rounding of the threshold are decided on the original vectors in double precision.
5. Tasks return a link count for each row and a spanning forest, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewise.llm import scratch
from tilewise.llm.components import components, hook
from tilewise.llm.vectors import distinct, matrix

#: Bytes of vectors in a tile, the least and most tiles, rows of the sample for cuts, rows compared at once, rounding allowed for.
TILE, FEW, TILES, SAMPLE, BLOCK, SLACK = 1 << 24, 8, 1 << 15, 50_000, 1024, 1e-4


def axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """Eigenvectors of the sum of x x' over unit rows, strongest first. Sums are added on the executors; dim^2 numbers come back."""

    def moments(batches):
        total = np.zeros((dim, dim))
        for b in batches:
            x = matrix(b.column(0), dim)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            total += x.T @ x
        at = np.arange(dim * dim)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total.reshape(-1))], names=["at", "v"])

    got = vectors.select("vec").mapInArrow(moments, "at int, v double").groupBy("at").agg(F.sum("v")).collect()
    total = np.zeros(dim * dim)
    for at, v in got:
        total[at] = v
    return np.linalg.eigh(total.reshape(dim, dim))[1][:, ::-1].copy()


class Cuts:
    """A k-d tree over the leading axes: leaves of about equal shares of the sample."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.nodes: list[tuple[int, float]] = []
        self.depth = max(0, int(np.ceil(np.log2(max(1, leaves)))))
        level = [sample]
        for d in range(self.depth):
            below = []
            for rows in level:
                axis = int(np.argmax(np.ptp(rows[:, :8], axis=0))) if len(rows) > 1 else d % min(8, sample.shape[1])
                cut = float(np.median(rows[:, axis])) if len(rows) else 0.0
                self.nodes.append((axis, cut))
                below += [rows[rows[:, axis] <= cut], rows[rows[:, axis] > cut]]
            level = below

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        if not self.depth:
            return at
        axis, cut = np.array([a for a, _ in self.nodes]), np.array([c for _, c in self.nodes])
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[np.arange(len(x)), axis[at]] > cut[at])
        return at - len(self.nodes)


def linked(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float):
    """(i, j) with cosine >= threshold, block by block. a, b: unit rows in PCA order; x, y: the original vectors.

    Products run in single precision within SLACK of what they are in double; whatever comes out within 2 SLACK of the
    threshold is computed anew in double.
    """
    dim = a.shape[1]
    steps = sorted({min(dim, s) for s in (dim // 2, 3 * dim // 4, dim) if s > 0})
    tail = lambda m: [np.sqrt(np.maximum(0, (m[:, s:] ** 2).sum(1))).astype(np.float32) for s in steps]
    ta, tb = tail(a), tail(b)
    a32, b32 = a.astype(np.float32), b.astype(np.float32)
    for p in range(0, len(a), BLOCK):
        for q in range(0, len(b), BLOCK):
            u, v = slice(p, p + BLOCK), slice(q, q + BLOCK)
            part = a32[u, : steps[0]] @ b32[v, : steps[0]].T
            reach = part + ta[0][u][:, None] * tb[0][v][None, :]
            i, j = np.nonzero(reach >= threshold - SLACK)
            part = part[i, j]
            for k in range(1, len(steps)):
                if len(i) > BLOCK * BLOCK // 8:  # most pairs are left: as matrices
                    more = (a32[u, steps[k - 1] : steps[k]] @ b32[v, steps[k - 1] : steps[k]].T)[i, j]
                else:
                    more = np.einsum("ij,ij->i", a32[u][i, steps[k - 1] : steps[k]], b32[v][j, steps[k - 1] : steps[k]])
                part = part + more
                keep = part + ta[k][u][i] * tb[k][v][j] >= threshold - SLACK
                i, j, part = i[keep], j[keep], part[keep]
            close = np.flatnonzero(part < threshold + SLACK)
            if len(close):
                f, g = x[u][i[close]], y[v][j[close]]
                exact = np.einsum("ij,ij->i", f, g) / (np.linalg.norm(f, axis=1) * np.linalg.norm(g, axis=1))
                keep = np.ones(len(i), bool)
                keep[close] = exact >= threshold
                i, j = i[keep], j[keep]
            if len(i):
                yield i + p, j + q


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of df. Links: cosine >= threshold in double precision.

    Rows that are null, all zeros, or hold null or non-finite components link with nothing: n_links 0, a component of
    their own. Vectors of unequal length are compared as if filled with zeros. Equal vectors link with each other; rows
    with the same id and vector count as separate vectors of one component. A row with a null id makes no links; its
    component is null and it isn't kept. An empty table gives an empty result. threshold must be above 0.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    spark = df.sparkSession
    vectors = scratch.save(distinct(df, id_col, vec_col), "vectors")
    rows, dim = vectors.agg(F.count("*"), F.max(F.size("vec"))).first()
    dim = dim or 1
    turn = axes(vectors, dim)
    tile = max(-(-rows // TILES), min(-(-rows // FEW), TILE // (8 * dim)), 1)
    leaves = -(-rows // tile)
    share = min(1.0, SAMPLE / max(1, rows))
    drawn = vectors.where(F.shiftrightunsigned(F.xxhash64("rep", F.lit("cuts")), 11) * F.lit(2.0**-53) < share).select("vec").toArrow()
    sample = matrix(drawn.column(0), dim)
    cuts = spark.sparkContext.broadcast((turn, Cuts((sample / np.linalg.norm(sample, axis=1, keepdims=True)) @ turn, leaves)))

    def place(batches):
        turn, tree = cuts.value
        for b in batches:
            x = matrix(b.column(0), dim)
            leaf = tree.leaf((x / np.linalg.norm(x, axis=1, keepdims=True)) @ turn)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *b.columns], names=["leaf", "vec", "rep", "n"])

    placed = scratch.save(vectors.mapInArrow(place, "leaf bigint, vec array<double>, rep bigint, n bigint"), "placed")
    parts = {r[0]: max(1, -(-r[1] // (2 * tile))) for r in placed.groupBy("leaf").count().collect()}
    first, total = {}, 0
    for leaf in sorted(parts):
        first[leaf] = total
        total += parts[leaf]
    shared = spark.sparkContext.broadcast((first, parts))

    def tile_of(leaf, rep):
        head, n = (np.array([d[k] for k in leaf.tolist()]) for d in shared.value)
        return head + (((rep.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % n.astype(np.uint64)).astype(np.int64)

    def sums(batches):
        total_, count = np.zeros((total, dim)), np.zeros(total, np.int64)
        for b in batches:
            x = matrix(b.column(1), dim)
            t = tile_of(b.column(0).to_numpy(), b.column(2).to_numpy())
            np.add.at(total_, t, x / np.linalg.norm(x, axis=1, keepdims=True))
            count += np.bincount(t, minlength=total)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at]), pa.array(list(total_[at]), pa.list_(pa.float64()))], names=["t", "n", "s"])

    added = placed.mapInArrow(sums, "t bigint, n bigint, s array<double>").select("t", "n", F.posexplode("s").alias("d", "v"))
    added = added.groupBy("t", "d").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    centre = np.zeros((total, dim))
    for r in added.collect():
        centre[r["t"], r["d"]] = r["v"] / r["n"]
    centres = spark.sparkContext.broadcast(centre)

    def radii(batches):
        far = np.full(total, -1.0)
        for b in batches:
            x = matrix(b.column(1), dim)
            t = tile_of(b.column(0).to_numpy(), b.column(2).to_numpy())
            np.maximum.at(far, t, np.linalg.norm(x / np.linalg.norm(x, axis=1, keepdims=True) - centres.value[t], axis=1))
        at = np.flatnonzero(far >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(far[at])], names=["t", "r"])

    radius = np.full(total, -10.0)
    for t, r in placed.mapInArrow(radii, "t bigint, r double").groupBy("t").agg(F.max("r")).collect():
        radius[t] = r
    balls = spark.sparkContext.broadcast(radius)
    reach = np.sqrt(2 - 2 * threshold) + SLACK

    def deal(batches):
        c, r, near = centres.value, balls.value, {}
        for b in batches:
            rep = b.column(2).to_numpy()
            t = tile_of(b.column(0).to_numpy(), rep)
            for k in np.unique(t).tolist():
                if k not in near:
                    near[k] = np.flatnonzero(np.linalg.norm(c - c[k], axis=1) <= reach + r + r[k])
                at = pa.array(np.flatnonzero(t == k))
                vec, ids, n = (b.column(i).take(at) for i in (1, 2, 3))
                for other in near[k].tolist():
                    key = min(k, other) * total + max(k, other)
                    m = len(at)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, key)), pa.array(np.full(m, k > other)), vec, ids, n], names=["pair", "side", "vec", "rep", "n"])

    def compare(key, table):
        own = key[0].as_py() // total == key[0].as_py() % total
        side, rep, n = (table.column(k).to_numpy() for k in ("side", "rep", "n"))
        order = np.lexsort((rep, side))
        x = matrix(table.column("vec"), dim)[order]
        side, rep, n = side[order], rep[order], n[order]
        y = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ cuts.value[0]
        cut = len(rep) if own else int(np.searchsorted(side, True))
        label, count = np.arange(len(rep)), np.zeros(len(rep), np.int64)
        rest = slice(0, None) if own else slice(cut, None)
        shift = 0 if own else cut
        for i, j in linked(y[:cut], y[rest], x[:cut], x[rest], threshold):
            j = j + shift
            if own:
                i, j = i[i != j], j[i != j]
            count += np.bincount(i, n[j], len(rep)).astype(np.int64)
            if not own:
                count += np.bincount(j, n[i], len(rep)).astype(np.int64)
            label = hook(label, i, j)
        at = np.flatnonzero((count > 0) | (label != np.arange(len(rep))))
        return pa.table({"rep": pa.array(rep[at], pa.int64()), "links": pa.array(count[at], pa.int64()), "root": pa.array(rep[label[at]], pa.int64())})

    dealt = placed.mapInArrow(deal, "pair bigint, side boolean, vec array<double>, rep bigint, n bigint")
    found = scratch.save(dealt.groupBy("pair").applyInArrow(compare, "rep bigint, links bigint, root bigint"), "links")
    joined = components(found, "rep", "root")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    facts = vectors.join(counts, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    facts = facts.select(F.col("vec").alias("_vec"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("_component"))
    key = F.when(F.col(id_col).isNotNull(), F.transform(vec_col, lambda x: x.cast("double") + 0.0))
    out = df.select(F.col(id_col), key.alias("_key")).join(facts, F.col("_key") == F.col("_vec"), "left")
    component = F.coalesce("_component", F.col(id_col).cast("bigint")).alias("component_id")
    return out.select(id_col, F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component, F.coalesce(component == F.col(id_col), F.lit(False)).alias("kept"))


def op4_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and component of every embedding."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP4_SQL = """
    WITH RECURSIVE good AS (
        SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ),
    link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.9),
    reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
    SELECT e.vec_id, (SELECT count(*) FROM link WHERE link.a = e.vec_id) AS n_links,
           (SELECT min(b) FROM reach WHERE reach.a = e.vec_id) AS component_id,
           (SELECT min(b) FROM reach WHERE reach.a = e.vec_id) = e.vec_id AS kept
    FROM embeddings e
"""
