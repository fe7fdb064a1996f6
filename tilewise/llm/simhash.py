"""Near-duplicates by SimHash, linked by a self-join of the binary trie of fingerprints.

1. ``fingerprints`` hashes every word shingle of the whole text (XXH64, seed 42) and takes the majority of each bit.
2. Equal fingerprints are one leaf. The trie is cut into nodes of at most ``NODE`` leaves, or an eighth of all where
   these are few: a fuller node is cut into its halves, down to 60 bits (16 leaves at most), so a crowd of close
   fingerprints is cut deeper than the rest. A leaf is sent to every node that its own must meet: with nodes at depth d
   to sum(C(d, i), i <= budget) of them, 8 at d = 3, 64 at d = 7, 988 at d = 18 (34 thousand million leaves).
3. Node pairs whose known bits differ in more than the budget are pruned; every other pair is a task of its own.
4. A task walks both subtrees together, adds up the bits in which the paths differ, prunes beyond the budget, and also
   prunes pairs of subtrees that are one component already. It returns a spanning forest of its links, never all pairs.
5. ``components`` joins the forests.

Cuts are broadcast as node prefixes: at most 60 (1 + leaves/NODE) numbers, whatever the texts are.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewise.llm import scratch
from tilewise.llm.components import components, hook
from tilewise.llm.memory import release

#: Bits of which leaves are counted at once, leaves of a node before it is cut again, node pairs walked at once.
STEP, NODE, BLOCK = 6, 1 << 17, 1 << 19
#: Nodes whose partners a task keeps; leaves come in the order of nodes, so few are needed.
KEPT = 64
#: Bytes of a text hashed at once; a block ends at white space.
TEXT_BLOCK = 1 << 21
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_SHIFTS = np.arange(63, -1, -1, dtype=np.uint64)


def _blocks(raw: bytes):
    at = 0
    while at < len(raw):
        cut = _SPACE.search(raw, at + TEXT_BLOCK)
        end = cut.start() if cut else len(raw)
        yield raw[at:end]
        at = end


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of hashes: a bit is 1 if set in over half of them."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[i : i + 4096].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(((2 * ones > len(hashes)).astype(np.uint64) << _SHIFTS).sum())


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint, unsigned. Words are runs of [^\\x20\\x09-\\x0D], A-Z lower-cased; no words: 0."""
    digest, ones, n, carry = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []
    for block in _blocks((text or "").encode("utf-8", "surrogatepass").lower()):
        words = carry + block.split()
        carry = words[-(shingle - 1) :] if shingle > 1 else []
        if len(words) < shingle:
            continue
        line = b" ".join(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        first, last = (end - size)[: len(words) - shingle + 1].tolist(), end[shingle - 1 :].tolist()
        h = np.array([digest(line[s:e], seed) for s, e in zip(first, last)], dtype=">u8")
        n += len(h)
        for i in range(0, len(h), 4096):
            ones += np.unpackbits(h[i : i + 4096].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    if not n:
        return digest(b" ".join(carry), seed) if carry else 0
    bits = (2 * ones > n).astype(np.uint64)
    return int((bits << _SHIFTS).sum())


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp) a row; fp is the fingerprint's 64 bits as a signed bigint. Null and empty texts have 0."""

    def run(batches):
        release()
        for b in batches:
            fp = np.array([simhash(t, shingle, seed) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp bigint")


class Trie:
    """The levels of the binary trie over sorted distinct 64-bit values. Nodes of a level are numbered from 0."""

    def __init__(self, values: np.ndarray):
        self.values, self.n = values, len(values)
        x = values[1:] ^ values[:-1]
        for s in (1, 2, 4, 8, 16, 32):
            x = x | (x >> np.uint64(s))
        self.common = 64 - np.bitwise_count(x).astype(np.int64)  # bits shared with the value before
        self.kept: dict[int, tuple] = {}

    def starts(self, depth: int) -> np.ndarray:
        return np.concatenate([[0], np.flatnonzero(self.common < depth) + 1])

    def level(self, depth: int) -> tuple:
        """starts, sizes, and each node's children at depth + 1 (-1: none)."""
        if depth not in self.kept:
            starts = self.starts(depth)
            size = np.diff(np.append(starts, self.n))
            left = right = None
            if depth < 64:
                below = self.starts(depth + 1)
                first = np.searchsorted(below, starts)
                two = np.diff(np.append(first, len(below))) == 2
                one = (self.values[starts] >> np.uint64(63 - depth)) & np.uint64(1) == 1
                left = np.where(one, -1, first)
                right = np.where(two, first + 1, np.where(one, first, -1))
            self.kept[depth] = starts, size, left, right
        return self.kept[depth]


def _span(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum.reduceat(values, starts), np.maximum.reduceat(values, starts)


def walk(a: np.ndarray, b: np.ndarray | None, budget: int) -> np.ndarray:
    """Component labels over a, then b, after linking values at ``budget`` bits or fewer: of a with b, or within a."""
    ta = Trie(a)
    tb = ta if b is None else Trie(b)
    own, shift = b is None, 0 if b is None else len(a)
    label, version, spans = np.arange(len(a) + (0 if own else len(b))), 0, {}
    stack = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int8))] if len(a) and tb.n else []
    while stack:
        depth, i, j, used = stack.pop()
        sa, na, la, ra = ta.level(depth)
        sb, nb, lb, rb = tb.level(depth)
        if version:
            if spans.get(depth, (-1,))[0] != version:
                x = _span(label[: len(a)], sa)
                spans[depth] = version, x, x if own else _span(label[shift:], sb)
            (low, high), (low2, high2) = spans[depth][1:]
            open_ = (low[i] != high[i]) | (low2[j] != high2[j]) | (low[i] != low2[j])
            i, j, used = i[open_], j[open_], used[open_]
        small = na[i] * nb[j] <= 128 if depth < 64 else np.ones(len(i), bool)
        if small.any():
            x, y = i[small], j[small]
            for at in range(0, len(x), BLOCK // 16):
                p, q = x[at : at + BLOCK // 16], y[at : at + BLOCK // 16]
                wide = nb[q]
                total = na[p] * wide
                k = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
                wide = np.repeat(wide, total)
                f, g = np.repeat(sa[p], total) + k // wide, np.repeat(sb[q], total) + k % wide
                near = np.bitwise_count(ta.values[f] ^ tb.values[g]) <= budget
                if own:
                    near &= f != g
                if near.any():
                    f, g = f[near], g[near] + shift
                    if (label[f] != label[g]).any():
                        label, version = hook(label, f, g), version + 1
            i, j, used = i[~small], j[~small], used[~small]
        if not len(i):
            continue
        cross, same = used < budget, (i != j) if own else np.ones(len(i), bool)
        parts = [(la[i][cross], rb[j][cross], used[cross] + 1), (ra[i][cross & same], lb[j][cross & same], used[cross & same] + 1), (la[i], lb[j], used), (ra[i], rb[j], used)]
        x, y, c = (np.concatenate(k) for k in zip(*parts))
        there = (x >= 0) & (y >= 0)
        x, y, c = x[there], y[there], c[there].astype(np.int8)
        for at in range(0, len(x), BLOCK):
            stack.append((depth + 1, x[at : at + BLOCK], y[at : at + BLOCK], c[at : at + BLOCK]))
    return label


def _cuts(leaves: DataFrame, node: int) -> list[tuple[int, int]]:
    """(prefix, depth) of the nodes of the cut. A job counts the leaves below all fuller nodes, ``STEP`` levels at once."""
    out, full, depth = [], [0], 0
    while full and depth < 60:
        prefix = F.shiftrightunsigned("fp", 64 - depth) if depth else F.lit(0).cast("bigint")
        few = leaves.sparkSession.createDataFrame([(int(x),) for x in full], "p bigint")  # fewer than leaves / node
        counts = dict.fromkeys(((f << STEP) + i for f in full for i in range(1 << STEP)), 0)
        below = leaves.join(F.broadcast(few), prefix == F.col("p"), "left_semi").groupBy(F.shiftrightunsigned("fp", 64 - depth - STEP).alias("p")).count()
        counts.update((r[0], r[1]) for r in below.collect())
        level = {f: [counts[(f << STEP) + i] for i in range(1 << STEP)] for f in full}
        full = []
        for f, n in level.items():
            stack = [(f, 0, n)]
            while stack:
                p, d, n = stack.pop()
                if sum(n) <= node or depth + d == 60:
                    out.append((p, depth + d))
                elif d == STEP:
                    full.append(p)
                else:
                    stack += [(2 * p, d + 1, n[: len(n) // 2]), (2 * p + 1, d + 1, n[len(n) // 2 :])]
        depth += STEP
    return out + [(p, depth) for p in full]


class Cut:
    """Which node of the cut trie holds a fingerprint, and which other nodes a node must meet."""

    def __init__(self, nodes: list[tuple[int, int]], budget: int):
        self.budget, self.near = budget, {}
        self.depth = np.array([d for _, d in nodes], np.uint64)
        self.top = np.array([p << (64 - d) & (1 << 64) - 1 for p, d in nodes], np.uint64)
        order = np.argsort(self.top)
        self.top, self.depth = self.top[order], self.depth[order]

    def node_of(self, fp: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.top, fp, side="right") - 1

    def partners(self, node: int) -> np.ndarray:
        """Nodes, itself included, with at most ``budget`` differences in the bits that both know. The last few answers are kept."""
        if node not in self.near:
            if len(self.near) >= KEPT:
                self.near.clear()
            known = np.minimum(self.depth, self.depth[node])
            x = (self.top ^ self.top[node]) >> (np.uint64(63) - known) >> np.uint64(1)
            self.near[node] = np.flatnonzero(np.bitwise_count(x) <= self.budget)
        return self.near[node]


def links(leaves: DataFrame, budget: int = 3, node: int = NODE) -> DataFrame:
    """(a, b): spanning edges between the ids of leaves (fp, rep) that are ``budget`` bits or fewer apart, in chains."""
    spark = leaves.sparkSession
    nodes = _cuts(leaves, max(16, min(node, -(-leaves.count() // 8))))
    cut, total = spark.sparkContext.broadcast(nodes), len(nodes)

    def deal(batches):
        c = Cut(cut.value, budget)
        for b in batches:
            fp, rep = b.column(0).to_numpy(), b.column(1).to_numpy()
            home = c.node_of(fp.view(np.uint64))
            order = np.argsort(home, kind="stable")
            fp, rep, home = fp[order], rep[order], home[order]
            edge = np.flatnonzero(np.diff(home, prepend=-1, append=-1))
            for lo, hi in zip(edge[:-1], edge[1:]):
                me, near = int(home[lo]), c.partners(int(home[lo]))
                blob = pa.scalar(fp[lo:hi].tobytes() + rep[lo:hi].tobytes(), pa.binary())
                key = np.minimum(me, near) * total + np.maximum(me, near)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array((me > near).astype(np.int8)), pa.repeat(blob, len(near))], names=["pair", "side", "leaves"])

    def join(key: tuple, table: pa.Table) -> pa.Table:
        own = key[0].as_py() // total == key[0].as_py() % total
        side, blobs, parts = table.column("side").to_pylist(), table.column("leaves").to_pylist(), []
        for s in (0,) if own else (0, 1):
            mine = [x for x, y in zip(blobs, side) if y == s]
            f = np.concatenate([np.frombuffer(x, np.uint64, len(x) // 16) for x in mine] or [np.zeros(0, np.uint64)])
            r = np.concatenate([np.frombuffer(x, np.int64, offset=len(x) // 2) for x in mine] or [np.zeros(0, np.int64)])
            order = np.argsort(f)
            parts.append((f[order], r[order]))
        ids = np.concatenate([r for _, r in parts])
        label = walk(parts[0][0], None if own else parts[1][0], budget) if len(ids) and all(len(f) for f, _ in parts) else np.arange(len(ids))
        at = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"a": pa.array(ids[at], pa.int64()), "b": pa.array(ids[label[at]], pa.int64())})

    # In the order of the trie, so that a task's leaves are of few nodes, one after the other.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = leaves.select("fp", "rep").repartitionByRange(parts, "fp").sortWithinPartitions("fp")
    dealt = ordered.mapInArrow(deal, "pair bigint, side tinyint, leaves binary")
    return dealt.groupBy("pair").applyInArrow(join, "a bigint, b bigint")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp, component_id): one row per row of df; component_id is the smallest id reachable by links.

    Null and empty texts have fingerprint 0 and link like any other. A row with a null id makes no links; it gets the
    component of its fingerprint if other rows have it, else null. Repeated rows and ties share fingerprint and
    component. An empty table gives an empty result. Other columns of df are not read.
    """
    fps = scratch.save(fingerprints(df, id_col, text_col, shingle, seed), "fps")
    leaves = scratch.save(fps.where(F.col(id_col).isNotNull()).groupBy("fp").agg(F.min(id_col).cast("bigint").alias("rep")), "leaves")
    found = components(links(leaves, budget))
    named = leaves.join(found, F.col("rep") == F.col("node"), "left").select(F.col("fp"), F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp", "left").select(id_col, "fp", "component_id")


def hex16(fp) -> F.Column:
    """A signed 64-bit fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    df = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return df.select("doc_id", hex16("fp").alias("fingerprint"), "component_id")
