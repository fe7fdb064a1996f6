import glob
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_sequences_text import brute_lcs
from tilewise import queries as core
from tilewise.functions import text as T
from tilewise.operators import serving, tiles, timing, vocabulary
from tilewise.plans import network
from tilewise.sources import images, tables, traces

DIR = "/root/testdata/sf0.001"


def lcs_numpy(a, b):
    """The table row by row: running maxima of what ends with a match."""
    names = {t: i for i, t in enumerate({*a, *b})}
    y = np.array([names[t] for t in b], np.int64)
    row = np.zeros(len(b) + 1, np.int32)
    for t in a:
        new = np.maximum(row[1:], np.where(y == names[t], row[:-1] + 1, 0))
        row[1:] = np.maximum.accumulate(new)
    return int(row[-1])


def test_numpy_lcs():
    r = np.random.default_rng(0)
    for _ in range(30):
        a, b = (list(r.integers(0, 4, r.integers(0, 30))) for _ in range(2))
        assert lcs_numpy(a, b) == brute_lcs(a, b)


def test_all_pairs_against_a_table(spark):
    docs = {r.doc_id: r.tokens for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", T.tokens("text").alias("tokens")).collect()}
    for name, made in (("rouge_l_pairs", lambda t: t), ("rouge_l_stem", lambda t: [T.stem(x) if len(x) > 3 else x for x in t])):
        got = {r.doc_id: r.f1 for r in core.QUERIES[name](spark, DIR).collect()}
        want = {d: (lcs_numpy(made(t), made(docs[d + 1])), len(t) + len(docs[d + 1])) for d, t in docs.items() if d + 1 in docs}
        assert got == {d: pytest.approx(2 * n / total if n else 0.0, abs=2e-6) for d, (n, total) in want.items()}


def test_beginnings_that_are_not_prefixes(spark):
    df = spark.createDataFrame([("a b c d e f".split(), "b x a c f".split())], "r array<string>, c array<string>")
    got = df.select(T.rouge_l_prefixes(F.col("r"), F.col("c"), (1, 2, 3, 4, 9)).alias("f")).first().f
    assert got == pytest.approx([2 * n / (6 + m) for n, m in ((1, 1), (1, 2), (1, 3), (2, 4), (3, 5))])


def test_images_come_back(spark, tmp_path):
    r = np.random.default_rng(0)
    raw = [(i, r.integers(0, 256, 7 * 5 * 3, dtype=np.uint8).tobytes(), 7, 5) for i in range(20)] + [(None, b"", 1, 1), (99, None, 1, 1)]
    df = spark.createDataFrame(raw, "image_id long, data binary, width int, height int").repartition(3)
    folder = f"file://{tmp_path}/images"
    for _ in range(2):  # a task that runs again leaves the same files
        assert images.write_images(df, folder).count() == 20
    got = {r.image.origin.rpartition("/")[2]: (bytes(r.image.data), r.image.width, r.image.height) for r in images.read_images(spark, folder).collect()}
    assert got == {f"{i}.png": (d, w, h) for i, d, w, h in raw[:20]}
    assert [r.g for r in spark.createDataFrame([(bytes([1, 9, 9, 255, 0, 0]),)], "d binary").select(images.grey("d").alias("g")).collect()] == [[1.0, 255.0]]


@pytest.mark.parametrize("hot", [5, 10**6])
def test_vocabulary(spark, hot):
    rows = [(1, ["b", "a", "b", None, "<pad>"]), (2, []), (3, [f"w{i:03d}" for i in range(60)]), (4, ["zz"])]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(3)
    words = vocabulary.build(df, hot=hot)
    place = {r.token: r.id for r in words.collect()}
    assert place == {"<pad>": 0, **{w: i + 1 for i, w in enumerate(sorted(["a", "b", "zz", *rows[2][1]]))}}
    coded = vocabulary.encode(spark.createDataFrame([*rows, (5, ["a", "new"])], df.schema), words, ["doc_id"])
    assert {r.doc_id: r.ids for r in coded.collect()} == {d: [place.get(t) for t in ts] for d, ts in [*rows, (5, ["a", "new"])]}
    back = {r.doc_id: r.text for r in vocabulary.decode(coded, words, ["doc_id"], limit=50).collect()}
    assert back == {1: "b a b", 2: "", 3: " ".join(rows[2][1][:50]), 4: "zz", 5: "a"}


def test_trace_sink(spark, tmp_path):
    folder = f"file://{tmp_path}/traces"
    kind = "name string, start long"
    assert traces.read_traces(spark, folder, kind).collect() == []
    traces.write_traces(spark.range(30).select(F.lit("a").alias("name"), F.col("id").alias("start")).repartition(3), folder)
    traces.write_traces(spark.range(5).select(F.lit("b").alias("name"), F.col("id").alias("start")), folder)
    assert sorted(map(tuple, traces.read_traces(spark, folder, kind).collect())) == sorted([("a", i) for i in range(30)] + [("b", i) for i in range(5)])
    broken = spark.range(40).repartition(4).select(F.when(F.col("id") == 33, F.raise_error(F.lit("lost")).cast("string")).otherwise("c").alias("name"), F.col("id").alias("start"))
    with pytest.raises(Exception, match="lost"):
        traces.write_traces(broken, folder)
    assert traces.read_traces(spark, folder, kind).where("name = 'c'").count() == 0
    listed = json.loads((tmp_path / "traces" / traces.LIST).read_text())
    assert sum(n for _, n in listed) == 35 and {n for n, _ in listed} <= {f.rpartition("/")[2] for f in glob.glob(f"{tmp_path}/traces/part-*")}


def test_report_comes_with_the_write(spark, tmp_path):
    rows = [(i, 0.0, 0.0, float(x), float(2 * x)) for i, x in enumerate((1, 2, 3, 10))]
    df = spark.createDataFrame(rows, "req_id long, arrival_time double, start_time double, first_token_time double, end_time double")
    m = serving.write_with_metrics(df, f"file://{tmp_path}/served")
    assert spark.read.parquet(f"file://{tmp_path}/served").count() == m["n"] == 4
    lines = [r.line for r in serving.metric_block(spark, m).orderBy("no").collect()]
    assert lines[1:6] == ["TTFT AVG      : 4.0000 s", "TTFT P95      : 8.9500 s", "Latency AVG   : 8.0000 s", "Latency P95   : 17.9000 s", "Throughput    : 4.00 tokens/s"]
    none = serving.metric_block(spark, serving.write_with_metrics(df.limit(0), f"file://{tmp_path}/none")).collect()
    assert none[1].line == "TTFT AVG      : null s"


def test_samples_of_groups(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 10 > 0, "hot").when(F.col("id") > 100, "some").alias("g")).repartition(6)
    a, b = ({tuple(r) for r in tiles.sample_rows(d, ["g"], 7, "id").collect()} for d in (df, df.repartition(2)))
    assert a == b and len(a) == 21
    plan = tiles.sample_rows(df, ["g"], 7, "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # before the shuffle and after it


def test_parts_that_a_table_lacks(spark):
    df = spark.createDataFrame([(0, 1), (0, 2), (11, 3)], "layer int, mlp int")
    names = {"attn": "Attention_Layer_{}", "mlp": "MLP_Layer_{}"}
    assert sorted(map(tuple, timing.named_parts(df, "layer", names).collect())) == [(0, "MLP_Layer_0"), (11, "MLP_Layer_11")]
    assert timing.named_parts(df, "layer", {"attn": "A{}"}).collect() == []


def layers(x):
    """What the network does, one row, position and head at a time."""
    h, out = np.array(x, float).reshape(8, 8), []
    for layer in range(3):
        q, k, v, o = (np.array([[sum(h[p, i] * np.sin(1.7 * i + 0.9 * j * (n + 1) + 2.3 * layer + n) / np.sqrt(8) for i in range(8)) for j in range(8)] for p in range(8)]) for n in range(4))
        mixed = np.zeros((8, 8))
        for head in (slice(0, 4), slice(4, 8)):
            for p in range(8):
                e = np.exp([q[p, head] @ k[s, head] / 2 for s in range(8)])
                mixed[p, head] = sum(w * v[s, head] for s, w in enumerate(e / e.sum()))
        h = h + np.tanh(mixed + o)
        out.append((h, k, v))
    return out


def cos(a, b):
    return a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-8)


def test_network_and_its_comparisons(spark, tmp_path):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=64).astype(np.float32).tolist(), 0) for i in range(4)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")

    def masked(v, k):
        return [x if i % 8 < 5 and i // 8 < 5 and i // 8 * 5 + i % 8 < k else 0.0 for i, x in enumerate(v)]

    whole = [layers(v) for _, v, _ in rows]
    step = {k: [layers(masked(v, k)) for _, v, _ in rows] for k in range(1, 26)}
    got = {(x.k, x.layer): (x.sim, x.n) for x in core.model_prefix_similarity(spark, str(tmp_path)).collect()}
    want = {(k, l): np.mean([cos(step[k][b][l][0][p], whole[b][l][0][p]) for b in range(4) for p in range(8)]) for k in (1, 5, 10, 15, 20, 25) for l in range(3)}
    assert got == {a: (pytest.approx(s, abs=1e-5), 32) for a, s in want.items()} and len({round(s, 4) for s in want.values()}) > 10
    got = {(x.k, x.layer): x.sim for x in core.model_incremental_similarity(spark, str(tmp_path)).collect()}
    assert got == {(k, l): pytest.approx(np.mean([cos(step[k - 1][b][l][0][p], step[k][b][l][0][p]) for b in range(4) for p in range(8)]), abs=1e-5) for k in range(2, 26) for l in range(3)}
    got = {(x.k, x.layer): (x.key_sim, x.value_sim, x.n) for x in core.model_kv_similarity(spark, str(tmp_path)).collect()}
    for k in range(2, 26):
        n = (k - 1) * 7 // 25 + 1
        for l in range(3):
            both = [[cos(step[k - 1][b][l][what][p, h : h + 4], step[k][b][l][what][p, h : h + 4]) for b in range(4) for p in range(n) for h in (0, 4)] for what in (1, 2)]
            assert got[k, l] == (pytest.approx(np.mean(both[0]), abs=1e-5), pytest.approx(np.mean(both[1]), abs=1e-5), 8 * n)
    assert network.forward(np.zeros((0, 64))).shape == (0, 576)


def test_labels_from_ten_on_and_signs(spark, tmp_path):
    rows = [(i, [1.0] * 30 + [float(-1 - i)] * 34, [3, 10, 128][i % 3]) for i in range(9)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert core.incremental_heatmap(spark, str(tmp_path)).columns == ["step", "l3", "l10", "l128"]
    assert core.kv_key_heatmap(spark, str(tmp_path)).columns == ["step", "l3", "l10", "l128"]
    assert len(core.layer_report(spark, str(tmp_path)).collect()) == 18
    sims = spark.createDataFrame([(1, 2, -0.12345), (1, 11, 0.5)], "k int, layer int, sim double")
    assert [r[0] for r in sims.select(T.fixed("sim", 4)).collect()] == [f"{-0.12345:.4f}", "0.5000"]


def test_tables_root(spark):
    assert tables.folder(spark, "x") != tables.folder(spark, "x")


def test_look_ups_scan_no_map(spark):
    """A look-up in a map of Spark is a scan of its keys, so a text of n distinct tokens took n squared steps."""
    n = 30_000
    df = spark.createDataFrame([(1, [f"w{i:05d}" for i in range(n)])], "doc_id long, tokens array<string>")
    words = vocabulary.build(df)
    coded = vocabulary.encode(df, words, ["doc_id"])
    back = vocabulary.decode(coded, words, ["doc_id"])
    assert "element_at" not in back._jdf.queryExecution().optimizedPlan().toString()
    row = back.select("ids", "text").first()
    assert row.ids == list(range(1, n + 1)) and row.text.split(" ") == [f"w{i:05d}" for i in range(n)]
