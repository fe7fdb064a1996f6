"""Verdicts on URLs: the longest rule of host and path, else gradient-boosted trees on lexical features.

The trees are learned from labelled URLs: rows that a rule covers, or rows that the caller labels. Features are lengths, path depth, shares of
digits and of other signs, entropy of the characters, parameters, labels of the host, and for the host's suffixes and
the path's first parts how often labelled URLs with them were blocked (smoothed counts, also learned). At most
``SAMPLE`` labelled rows (expected number, by a hash of the URL; never more than twice that) are fitted on the driver; the model is a few kilobytes
and is broadcast. Every URL is scored where it is read, without a shuffle.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewise.llm import scratch

#: Labelled URLs to learn from, trees, depth, bins of a feature, rate, rows of a leaf at least, what counts of suffixes are smoothed by, parts of the rows of which each takes its counts from the others.
SAMPLE, TREES, DEPTH, BINS, RATE, LEAF, SMOOTH, FOLDS = 20_000, 40, 3, 32, 0.2, 5, 4.0, 4
#: (verdict, host, path) of the registered query.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "example.net", "/de/8"), ("allow", "net", "/de/"), ("block", "org", "/es/"))


def host_of(url: str | Column) -> Column:
    """What stands between the first :// and the next /, ? or #, A-Z lower-cased; without ://, or for null: empty."""
    c = F.col(url) if isinstance(url, str) else url
    host = F.regexp_extract(c, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: str | Column) -> Column:
    """What follows the host up to ? or #; without ://, or for null: empty."""
    c = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.regexp_extract(c, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits as struct (rule, verdict), else null; ties to the smaller rule.

    A rule fits its host and all hosts below it, if the path starts with the rule's. Few rules are expected: each is a condition.
    """
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def keys(host: str, path: str) -> list[str]:
    """Suffixes of the host (one to three labels) and beginnings of the path (one and two parts)."""
    labels, parts = host.split("."), path.split("/")
    return [".".join(labels[-n:]) for n in (1, 2, 3)] + ["/".join(parts[: n + 1]) + "/" for n in (1, 2)] + [labels[-1] + "/".join(parts[:2]) + "/"]


def lexical(url: str, host: str, path: str) -> list[float]:
    """Features of a URL alone."""
    n = max(1, len(url))
    count = Counter(url)
    entropy = -sum(c / n * math.log2(c / n) for c in count.values())
    query = url.partition("?")[2].partition("#")[0]
    digits = sum(count[d] for d in "0123456789")
    return [
        len(url), len(host), len(path), path.count("/"), host.count("."), host.count("-"), digits / n,
        sum(c for k, c in count.items() if not k.isalnum()) / n, entropy, len(query.split("&")) if query else 0,
        len(query), float("#" in url), float(url[:6].lower() == "https:"), max(map(len, host.split(".")), default=0), sum(x.isdigit() for x in path.split("/")),
    ]


@dataclass
class Trees:
    """Boosted trees of logistic loss. Trees are complete: feature and threshold of each inner node, value of each leaf."""

    start: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    rates: dict[str, float]
    base: float

    def features(self, urls: Sequence[str], hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
        rows = [lexical(u, h, p) + [self.rates.get(k, self.base) for k in keys(h, p)] for u, h, p in zip(urls, hosts, paths)]
        return np.array(rows, dtype=np.float64).reshape(len(rows), -1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of block."""
        z = np.full(len(x), self.start)
        for feature, cut, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
            z += leaf[at - len(feature)]
        return 1 / (1 + np.exp(-z))


def _grow(bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tree on gradients g and curvatures h, by histograms."""
    inner = 2**DEPTH - 1
    feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
    at = np.zeros(len(g), np.int64)
    for node in range(inner):
        rows = np.flatnonzero(at == node)
        best = 1e-9
        if len(rows) >= 2 * LEAF:
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for f, e in enumerate(edges):
                b = bins[rows, f]
                gs, hs, ns = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g[rows], h[rows], None))
                gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
                gain[(ns < LEAF) | (len(rows) - ns < LEAF)] = 0
                if len(gain) and gain.max() > best:
                    best, k = gain.max(), int(gain.argmax())
                    feature[node], cut[node] = f, e[k]
        side = np.zeros(len(rows), bool)
        if np.isfinite(cut[node]):
            side = bins[rows, feature[node]] > np.searchsorted(edges[feature[node]], cut[node])
        at[rows] = 2 * node + 1 + side
    leaf = at - inner
    n = 2**DEPTH
    return feature, cut, -RATE * np.bincount(leaf, g, n) / (np.bincount(leaf, h, n) + 1)


def train(rows: Sequence[tuple[str, str, str, int]]) -> Trees:
    """Trees from (url, host, path, 1 for block) rows, the same for any order of them. No rows, or one verdict alone: a constant."""
    rows = sorted(rows)
    y = np.array([r[3] for r in rows], dtype=np.float64)
    base = (y.sum() + 1) / (len(y) + 2)
    model = Trees(math.log(base / (1 - base)), [], {}, base)
    if len(set(y)) < 2:
        return model
    seen: dict[str, np.ndarray] = defaultdict(lambda: np.zeros((FOLDS, 2)))
    of = [keys(host, path) for _, host, path, _ in rows]
    for i, (own, v) in enumerate(zip(of, y)):
        for k in own:
            seen[k][i % FOLDS] += v, 1
    total = {k: c.sum(0) for k, c in seen.items()}
    model.rates = {k: (v + SMOOTH * base) / (n + SMOOTH) for k, (v, n) in total.items() if n > 1}
    # A row's own label, and its part's, is no evidence for it.
    others = [[(total[k][0] - seen[k][i % FOLDS][0] + SMOOTH * base) / (total[k][1] - seen[k][i % FOLDS][1] + SMOOTH) for k in own] for i, own in enumerate(of)]
    x = np.array([lexical(*r[:3]) + o for r, o in zip(rows, others)], dtype=np.float64)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], 1)
    for _ in range(TREES):
        p = model.score(x)
        model.trees.append(_grow(bins, edges, p - y, p * (1 - p)))
    return model


def judge(df: DataFrame, url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """df with host, path, rule, verdict and score (of the trees, null under a rule); columns of these names are replaced.

    labelled: (url, label 1 for block), by default what the rules say of df's own rows. Null, empty and odd URLs have
    empty host and path and are judged by the trees like any other. Equal URLs get equal verdicts. Without labelled rows
    the verdict is a coin's constant: allow. An empty table stays empty. Other columns pass through.
    """
    new = ("host", "path", "rule", "verdict", "score")
    rest, own = scratch.others(df, new), scratch.prefix(df)
    url, names = F.coalesce(F.col(url_col), F.lit("")), [f"{own}{x}" for x in ("url", "host", "path")]
    parts = df.select(*[f"`{c}`" for c in rest], *(c.alias(n) for c, n in zip((url, host_of(url_col), path_of(url_col)), names)))
    ruled = parts.withColumn(f"{own}r", rule_of(F.col(names[1]), F.col(names[2]), rules))
    if labelled is None:
        known = ruled.where(F.col(f"{own}r").isNotNull()).select(*(F.col(n).alias(k) for n, k in zip(names, ("_url", "_host", "_path"))), (F.col(f"{own}r.verdict") == "block").cast("int").alias("_y"))
    else:
        known = labelled.where("url is not null and label is not null").select(F.col("url").alias("_url"), host_of("url").alias("_host"), path_of("url").alias("_path"), F.col("label").cast("int").alias("_y"))
    total = known.count()
    drawn = known
    if total > sample:
        drawn = known.where(F.shiftrightunsigned(F.xxhash64("_url", F.lit("sample")), 11) * F.lit(2.0**-53) < sample / total)
    grouped = drawn.groupBy("_url", "_host", "_path", "_y").count()  # a URL of many rows is sent once
    most = math.ceil(2 * sample)
    model = train([tuple(r)[:4] for r in grouped.orderBy(F.xxhash64("_url", F.lit("sample")), "_url", "_y").limit(most).collect()])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            url, host, path, found = (b.column(len(rest) + i).to_pylist() for i in range(4))
            score = m.score(m.features(url, host, path)) if url else np.zeros(0)
            rule = [f and f["rule"] for f in found]
            verdict = [f["verdict"] if f else "block" if s > threshold else "allow" for f, s in zip(found, score)]
            score = [None if f else float(s) for f, s in zip(found, score)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], *(pa.array(v, pa.string()) for v in (host, path, rule, verdict)), pa.array(score, pa.float64())], names=[*rest, *new])

    from pyspark.sql.types import StructType, _parse_datatype_string

    schema = StructType([df.schema[c] for c in rest] + _parse_datatype_string("host string, path string, rule string, verdict string, score double").fields)
    return ruled.mapInArrow(run, schema)


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "score")
