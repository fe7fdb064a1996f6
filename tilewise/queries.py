"""The registered queries and, beside each, DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewise.functions import text as T
from tilewise.functions.times import micros, seconds
from tilewise.functions.vectors import cosine, keep, keep_prefix, tile_mask
from tilewise.operators import chat, compare, sequences, serving, tiles, timing, vocabulary
from tilewise.plans import experiments as X
from tilewise.plans import network
from tilewise.sources import images, tables, traces

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")


def _r(*names: str, digits: int = 6) -> list:
    return [F.round(n, digits).alias(n) for n in names]


def _mask(k: str, v: str = "v") -> str:
    return f"list_transform({v}, lambda x, i: CASE WHEN (i - 1) // 8 < 5 AND (i - 1) % 8 < 5 AND ((i - 1) // 8) * 5 + (i - 1) % 8 < {k} THEN x ELSE 0.0 END)"


def _cos(a: str, b: str) -> str:
    return f"list_inner_product({a}, {b}) / greatest(sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})), 1e-8)"


_ROWS = "base AS (SELECT label AS layer, vec_id AS pos, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_PREFIX = f"""{_ROWS}, masked AS (SELECT k, layer, v, {_mask("k")} AS m FROM base, (SELECT unnest([1, 5, 10, 15, 20, 25]) AS k)),
    sims AS (SELECT k, layer, avg({_cos("m", "v")}) AS sim, count(*) AS n FROM masked GROUP BY k, layer)"""
_INCREMENTAL = f"""{_ROWS}, masked AS (SELECT k, layer, {_mask("k - 1")} AS p, {_mask("k")} AS m FROM base, (SELECT CAST(unnest(range(2, 26)) AS INTEGER) AS k)),
    sims AS (SELECT k, layer, avg({_cos("p", "m")}) AS sim, count(*) AS n FROM masked GROUP BY k, layer)"""
_SAMPLE = """sample AS (
        SELECT k, trial, idx FROM (
            SELECT k, trial, idx, row_number() OVER (PARTITION BY k, trial ORDER BY md5(concat_ws('-', k, trial, idx)), idx) AS n
            FROM (SELECT unnest([1, 5, 10, 15, 20]) AS k), (SELECT CAST(unnest(range(0, 10)) AS INTEGER) AS trial), (SELECT CAST(unnest(range(0, 25)) AS INTEGER) AS idx))
        WHERE n <= k)"""
_SETS = _SAMPLE + ", sets AS (SELECT k, trial, list(idx) AS tiles FROM sample GROUP BY k, trial)"
_KEEP = "list_transform(v, lambda x, i: CASE WHEN (i - 1) // 8 < 5 AND (i - 1) % 8 < 5 AND list_contains(tiles, ((i - 1) // 8) * 5 + (i - 1) % 8) THEN x ELSE 0.0 END)"
_TRIALS = f"""{_ROWS}, {_SETS}, kept AS (SELECT k, trial, layer, v, {_KEEP} AS m FROM base, sets),
    sims AS (SELECT k, trial, layer, avg({_cos("m", "v")}) AS sim FROM kept GROUP BY k, trial, layer)"""
_KV = f"""{_ROWS}, numbered AS (SELECT layer, v, pos, row_number() OVER (PARTITION BY layer ORDER BY pos DESC) AS back FROM base),
    masked AS (SELECT k, layer, pos, {_mask("k")} AS m FROM numbered, (SELECT CAST(unnest(range(1, 26)) AS INTEGER) AS k) WHERE back > 25 - k),
    cache AS (SELECT k, layer, pos, list_filter(m, lambda x, i: i % 2 = 1) AS key, list_filter(m, lambda x, i: i % 2 = 0) AS value FROM masked),
    sims AS (SELECT c.k, c.layer, avg({_cos("p.key", "c.key")}) AS key_sim, avg({_cos("p.value", "c.value")}) AS value_sim, count(*) AS n
             FROM cache c JOIN cache p ON p.k = c.k - 1 AND p.layer = c.layer AND p.pos = c.pos GROUP BY c.k, c.layer)"""
_REQUESTS = """burst AS (SELECT event_id AS req_id, epoch_us(date_trunc('day', ts)) // 86400000000 AS day, epoch_us(ts) / 1e6 AS t0, value FROM events),
    arrived AS (SELECT req_id, day, min(t0) OVER (PARTITION BY day) AS arrival_time, value, CAST((row_number() OVER (PARTITION BY day ORDER BY req_id) - 1) // 16 AS INTEGER) AS batch FROM burst),
    served AS (SELECT day, batch, max(value) AS service FROM arrived GROUP BY day, batch),
    waited AS (SELECT day, batch, service, 1.01 * coalesce(sum(service) OVER (PARTITION BY day ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wait FROM served),
    timed AS (SELECT req_id, day, batch, arrival_time, arrival_time + wait AS start_time, arrival_time + wait + service * 0.01 AS first_token_time, arrival_time + wait + service * 0.01 + service AS end_time
              FROM arrived JOIN waited USING (day, batch))"""
_TOKENS = "list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '')"


@query(f"WITH {_PREFIX} SELECT k, layer, round(sim, 6) AS sim, n FROM sims")
def prefix_similarity(spark, sf_dir):
    return X.prefix_experiment(_embeddings(spark, sf_dir)).select("k", "layer", *_r("sim"), "n")


@query(f"WITH {_PREFIX} SELECT k, layer, round(sim, 6) AS sim, n FROM sims")
def layer_comparison(spark, sf_dir):
    """The same by the operator on stored states, which checks shapes."""
    rows = _embeddings(spark, sf_dir)
    full = rows.select(F.col("label").alias("layer"), F.lit(0).alias("b"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"))
    return compare.compare_layers(X.hidden_states(rows, X.PREFIXES), full).select("k", "layer", *_r("sim"), "n")


@query(f"WITH {_PREFIX} SELECT k, round(max_by(sim, layer), 6) AS sim FROM sims GROUP BY k")
def saturation_curve(spark, sf_dir):
    return compare.last_layer(X.prefix_experiment(_embeddings(spark, sf_dir))).select("k", *_r("sim"))


@query("""
    WITH sized AS (SELECT p_partkey AS image_id, (p_size + 10) // 5 AS tw, (p_size % 7 + 8) // 5 AS th FROM part), grid AS (SELECT CAST(unnest(range(0, 25)) AS INTEGER) AS idx)
    SELECT image_id, idx, idx // 5 AS r, idx % 5 AS c, (idx % 5) * tw AS "left", (idx // 5) * th AS upper, (idx % 5 + 1) * tw AS "right", (idx // 5 + 1) * th AS lower FROM sized, grid
""")
def tile_grid(spark, sf_dir):
    sized = _table(spark, sf_dir, "part", "p_partkey", "p_size")
    return tiles.tile_grid(sized.select(F.col("p_partkey").alias("image_id"), (F.col("p_size") + 10).alias("width"), (F.col("p_size") % 7 + 8).alias("height")))


@query(f"""
    WITH {_ROWS}, masked AS (SELECT k, pos, {_mask("k")} AS m FROM base, (SELECT unnest([0, 1, 5, 10, 15, 20, 25]) AS k))
    SELECT k, pos AS vec_id, CAST(len(list_filter(m, lambda x: x <> 0)) AS INTEGER) AS kept, round(list_sum(m), 6) AS total FROM masked
""")
def prefix_mask(spark, sf_dir):
    rows = _embeddings(spark, sf_dir).select("vec_id", "embedding", F.explode(F.array(*[F.lit(k) for k in (0, *X.PREFIXES)])).alias("k"))
    return _mask_facts(rows.select("k", "vec_id", keep_prefix("embedding", "k").alias("m")), "k", "vec_id")


def _mask_facts(rows: DataFrame, *names: str) -> DataFrame:
    total = F.aggregate("m", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rows.select(*names, F.size(F.filter("m", lambda x: x != 0)).alias("kept"), F.round(total, 6).alias("total"))


@query("""
    WITH tile AS (SELECT p_partkey AS image_id, CAST(unnest(range(0, 25)) AS INTEGER) AS idx FROM part),
    ordered AS (SELECT image_id, idx, row_number() OVER (PARTITION BY image_id ORDER BY md5(concat_ws('-', image_id, idx)), idx) AS n FROM tile)
    SELECT image_id, idx FROM ordered WHERE n <= 5
""")
def tile_sample(spark, sf_dir):
    """Five tiles of each image."""
    return tiles.sample_grid(_table(spark, sf_dir, "part", F.col("p_partkey").alias("image_id")), 5)


@query("""
    WITH ordered AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), CAST(doc_id AS VARCHAR)) AS n FROM documents) SELECT source, doc_id FROM ordered WHERE n <= 20
""")
def group_sample(spark, sf_dir):
    """Twenty documents of each source."""
    return tiles.sample_rows(_table(spark, sf_dir, "documents", "source", "doc_id"), ["source"], 20, F.col("doc_id").cast("string"))


@query(f"""
    WITH {_ROWS}, {_SETS}, kept AS (SELECT k, trial, pos, {_KEEP} AS m FROM base, sets)
    SELECT k, trial, pos AS vec_id, CAST(len(list_filter(m, lambda x: x <> 0)) AS INTEGER) AS kept, round(list_sum(m), 6) AS total FROM kept
""")
def random_mask(spark, sf_dir):
    sets = tiles.tile_sets(tiles.tile_sample(spark, X.SAMPLED)).select("k", "trial", tile_mask("tiles").alias("mask"))
    rows = _embeddings(spark, sf_dir).crossJoin(F.broadcast(sets))  # 50 sets, whatever the data
    return _mask_facts(rows.select("k", "trial", "vec_id", keep("embedding", "mask").alias("m")), "k", "trial", "vec_id")


@query(f"""
    WITH {_TRIALS}, stats AS (SELECT k, layer, avg(sim) AS mean, stddev_pop(sim) AS std FROM sims GROUP BY k, layer)
    SELECT k, layer, round(mean, 6) AS mean, round(std, 6) AS std, round(mean - std, 6) AS low, round(mean + std, 6) AS high FROM stats
""")
def random_similarity_stats(spark, sf_dir):
    return compare.trial_stats(X.random_experiment(_embeddings(spark, sf_dir))).select("k", "layer", *_r("mean", "std", "low", "high"))


@query(f"WITH {_INCREMENTAL} SELECT k, layer, round(sim, 6) AS sim, n FROM sims")
def incremental_similarity(spark, sf_dir):
    return X.incremental_experiment(_embeddings(spark, sf_dir)).select("k", "layer", *_r("sim"), "n")


@query(f"WITH {_INCREMENTAL} SELECT k, layer, round(sim, 6) AS sim, n FROM sims")
def incremental_comparison(spark, sf_dir):
    """The same by the operator on stored states, which looks one step back."""
    return compare.compare_incremental(X.hidden_states(_embeddings(spark, sf_dir), range(1, 26))).select("k", "layer", *_r("sim"), "n")


def _pivot(sims: str, value: str) -> str:
    return f"""WITH {sims}, named AS (SELECT (k - 1) || '->' || k AS step, 'l' || layer AS layer, {value} AS v FROM sims) PIVOT named ON layer USING round(max(v), 6) GROUP BY step"""


def _heatmap(sims: DataFrame, value: str = "sim") -> DataFrame:
    wide = compare.heatmap(sims, value=value)
    return wide.select("step", *_r(*wide.columns[1:]))


@query(_pivot(_INCREMENTAL, "sim"))
def incremental_heatmap(spark, sf_dir):
    return _heatmap(X.incremental_experiment(_embeddings(spark, sf_dir)))


@query(f"WITH {_KV} SELECT k, layer, round(key_sim, 6) AS key_sim, round(value_sim, 6) AS value_sim, n FROM sims")
def kv_similarity(spark, sf_dir):
    return X.kv_experiment(_embeddings(spark, sf_dir)).select("k", "layer", *_r("key_sim", "value_sim"), "n")


@query(f"""
    WITH {_KV[: _KV.index("cache AS")]} cache AS (
        SELECT k, layer, pos, pos % 2 AS b, head, list_filter(m, lambda x, i: i % 2 = 1)[8 * head + 1 : 8 * head + 8] AS key, list_filter(m, lambda x, i: i % 2 = 0)[8 * head + 1 : 8 * head + 8] AS value
        FROM masked, (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS head))
    SELECT c.k, c.layer, round(avg({_cos("p.key", "c.key")}), 6) AS key_sim, round(avg({_cos("p.value", "c.value")}), 6) AS value_sim, count(*) AS n
    FROM cache c JOIN cache p ON p.k = c.k - 1 AND p.layer = c.layer AND p.b = c.b AND p.head = c.head AND p.pos = c.pos GROUP BY c.k, c.layer
""")
def kv_comparison(spark, sf_dir):
    """The same kind of caches in two sequences and four heads, by the operator on stored caches."""
    return compare.compare_kv(X.kv_cache(_embeddings(spark, sf_dir), batch=2, heads=4)).select("k", "layer", *_r("key_sim", "value_sim"), "n")


@query(f"WITH {_KV} SELECT k, round(avg(key_sim), 6) AS key_sim, round(avg(value_sim), 6) AS value_sim FROM sims GROUP BY k")
def kv_step_summary(spark, sf_dir):
    return compare.step_summary(X.kv_experiment(_embeddings(spark, sf_dir))).select("k", *_r("key_sim", "value_sim"))


@query(_pivot(_KV, "key_sim"))
def kv_key_heatmap(spark, sf_dir):
    return _heatmap(X.kv_experiment(_embeddings(spark, sf_dir)), "key_sim")


@query(_pivot(_KV, "value_sim"))
def kv_value_heatmap(spark, sf_dir):
    return _heatmap(X.kv_experiment(_embeddings(spark, sf_dir)), "value_sim")


def _requests(spark, sf_dir) -> DataFrame:
    """Events as requests: a burst each day, all at its first second."""
    rows = _table(spark, sf_dir, "events", "event_id", "ts", "value").select(F.col("event_id").alias("req_id"), F.floor(micros("ts") / 86_400_000_000).cast("bigint").alias("day"), seconds("ts").alias("at"), "value")
    first = rows.groupBy("day").agg(F.min("at").alias("arrival_time"))
    return serving.assign_batches(rows.join(first, "day").drop("at"), 16, ["day"])


def _served(spark, sf_dir) -> DataFrame:
    return serving.serve(_requests(spark, sf_dir), F.max("value"), ["day"])


@query(f"WITH {_REQUESTS} SELECT req_id, day, batch FROM arrived")
def batch_assign(spark, sf_dir):
    return _requests(spark, sf_dir).select("req_id", "day", "batch")


@query(f"WITH {_REQUESTS} SELECT req_id, day, batch, round(start_time - arrival_time, 4) AS queue_s, round(first_token_time - arrival_time, 4) AS ttft, round(end_time - arrival_time, 4) AS latency FROM timed")
def request_phases(spark, sf_dir):
    since = lambda c: F.round(F.col(c) - F.col("arrival_time"), 4)
    return _served(spark, sf_dir).select("req_id", "day", "batch", since("start_time").alias("queue_s"), since("first_token_time").alias("ttft"), since("end_time").alias("latency"))


@query(f"""
    WITH {_REQUESTS}
    SELECT day, count(*) AS n, round(avg(first_token_time - arrival_time), 4) AS ttft_avg, round(quantile_cont(first_token_time - arrival_time, 0.95), 4) AS ttft_p95,
           round(avg(end_time - arrival_time), 4) AS latency_avg, round(quantile_cont(end_time - arrival_time, 0.95), 4) AS latency_p95, round(count(*) * 20.0 / (max(end_time) - min(arrival_time)), 6) AS throughput
    FROM timed GROUP BY day
""")
def request_metrics(spark, sf_dir):
    m = serving.request_metrics(_served(spark, sf_dir), ["day"])
    return m.select("day", "n", *_r("ttft_avg", "ttft_p95", "latency_avg", "latency_p95", digits=4), *_r("throughput"))


@query("""
    WITH numbered AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events)
    SELECT event_type, count(*) AS n, round(avg(value) * 1000, 4) AS mean_ms FROM numbered WHERE n > 3 GROUP BY event_type
""")
def timing_summary(spark, sf_dir):
    rows = _table(spark, sf_dir, "events", "event_id", "ts", "event_type", F.col("value").alias("elapsed_s"))
    return timing.timing_summary(rows, ["event_type"], ["ts", "event_id"], warmup=3).select("event_type", "n", *_r("mean_ms", digits=4))


@query("""
    WITH reset AS (SELECT user_id, max(ts) AS at FROM events WHERE event_type = 'error' GROUP BY user_id)
    SELECT e.user_id, max(value) AS peak FROM events e LEFT JOIN reset r ON e.user_id = r.user_id
    WHERE event_type <> 'error' AND (r.at IS NULL OR e.ts >= r.at) GROUP BY e.user_id
""")
def peak_since_reset(spark, sf_dir):
    return timing.peak_since_reset(_table(spark, sf_dir, "events", "user_id", "ts", "event_type", "value"), ["user_id"], F.col("event_type") == "error", value="value")


@query("""
    WITH called AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-10')
    SELECT event_id, user_id, 'prefill' AS target FROM called WHERE n = 1
    UNION ALL SELECT event_id, user_id, 'vision' FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-10'
""")
def first_after_enable(spark, sf_dir):
    calls = _table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type")
    on = F.lit("2024-01-10").cast("timestamp_ntz")
    prefill = timing.first_after_enable(calls.where("event_type = 'click'"), on, ["user_id"], ["ts", "event_id"])
    vision = timing.first_after_enable(calls.where("event_type = 'view'"), on, ["user_id"], ["ts", "event_id"], once=False)
    pick = lambda d, name: d.select("event_id", "user_id", F.lit(name).alias("target"))
    return pick(prefill, "prefill").union(pick(vision, "vision"))


@query("""
    WITH e AS (SELECT user_id, epoch_us(ts) // 86400000000 AS day, epoch_us(ts) AS t0, event_id, event_type FROM events),
    o AS (SELECT *, row_number() OVER w AS n, lead(t0) OVER w AS nxt FROM e WINDOW w AS (PARTITION BY user_id, day ORDER BY t0, event_id))
    SELECT user_id, day, 'session' AS name, min(t0) AS start, max(t0) AS "end", 1 AS depth FROM o GROUP BY user_id, day
    UNION ALL SELECT user_id, day, event_type, t0, nxt, 2 FROM o WHERE nxt IS NOT NULL
""")
def span_pairs(spark, sf_dir):
    """Sessions of a user's day, with a range from each event to the next, as push and pop events that are paired again."""
    e = _table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type").select("user_id", F.floor(micros("ts") / 86_400_000_000).cast("bigint").alias("day"), micros("ts").alias("ts"), "event_id", "event_type")
    at = Window.partitionBy("user_id", "day").orderBy("ts", "event_id")
    e = e.withColumn("n", F.row_number().over(at)).withColumn("next", F.lead("ts").over(at))
    event = lambda op, name, n: F.struct(F.lit(op).alias("op"), name.alias("name"), F.lit(n).alias("o"))
    push, pop = event("push", F.col("event_type"), 3), event("pop", F.lit(None).cast("string"), 1)
    outer, close = event("push", F.lit("session"), 2), event("pop", F.lit(None).cast("string"), 4)
    both = F.array_compact(F.array(F.when(F.col("n") > 1, pop), F.when(F.col("n") == 1, outer), F.when(F.col("next").isNotNull(), push), F.when(F.col("next").isNull(), close)))
    trace = e.select("user_id", "day", "ts", "n", F.explode(both).alias("x")).select("user_id", "day", "ts", "n", "x.*")
    return timing.span_pairs(trace, ["user_id", "day"], ["n", "o"])


_ITEMS = """items AS (SELECT conv_id AS seq_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos,
        CASE WHEN role = 'system' THEN 24 ELSE len(list_filter(string_split(coalesce(text, ''), ' '), lambda t: t <> '')) END AS len FROM conversations)"""


@query(f"""
    WITH RECURSIVE {_ITEMS}, f AS (
        SELECT seq_id, pos, 0 AS chunk, len AS run, len FROM items WHERE pos = 1
        UNION ALL SELECT i.seq_id, i.pos, CASE WHEN f.run >= 64 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.run >= 64 THEN i.len ELSE f.run + i.len END, i.len
        FROM f JOIN items i ON i.seq_id = f.seq_id AND i.pos = f.pos + 1),
    c AS (SELECT seq_id, chunk, count(*) AS n_items, sum(len) AS len FROM f GROUP BY seq_id, chunk)
    SELECT seq_id, chunk, n_items, CAST(len AS BIGINT) AS len, CAST(sum(len) OVER (PARTITION BY seq_id ORDER BY chunk) AS BIGINT) AS cache_len FROM c
""")
def greedy_chunks(spark, sf_dir):
    """Turns as items: system turns stand for an image of 24 vectors, others have a vector a word."""
    turns = _table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda t: t != ""))
    items = turns.select(F.col("conv_id").alias("seq_id"), F.col("turn").alias("pos"), F.when(F.col("role") == "system", 24).otherwise(words).alias("len"))
    return sequences.greedy_chunks(items, 64).withColumn("chunk", F.col("chunk").cast("int"))


@query("""
    WITH tile AS (SELECT vec_id // 10 AS image_id, vec_id AS t, embedding AS v FROM embeddings), j AS (SELECT image_id, flatten(list(v ORDER BY t)) AS v FROM tile GROUP BY image_id)
    SELECT image_id, CAST(len(v) AS INTEGER) AS n, round(list_sum(list_transform(v, lambda x, i: CAST(x AS DOUBLE) * i)), 5) AS checksum FROM j
""")
def concat_tiles(spark, sf_dir):
    parts = _embeddings(spark, sf_dir).select(F.floor(F.col("vec_id") / 10).cast("bigint").alias("image_id"), "vec_id", F.col("embedding").alias("v"))
    joined = sequences.concat_ordered(parts, ["image_id"], "vec_id", "v")
    weighted = F.aggregate(F.transform("v", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return joined.select("image_id", F.size("v").alias("n"), F.round(weighted, 5).alias("checksum"))


@query("""
    WITH t AS (SELECT conv_id, turn, string_split(coalesce(text, ''), ' ') AS tokens FROM conversations), p AS (SELECT conv_id, turn, tokens, max(len(tokens)) OVER (PARTITION BY conv_id) AS longest FROM t)
    SELECT conv_id, turn, CAST(longest AS INTEGER) AS padded, CAST(len(tokens) AS INTEGER) AS mask_sum, CASE WHEN len(tokens) < longest THEN '<pad>' ELSE tokens[len(tokens)] END AS last_token FROM p
""")
def pad_batch(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", F.split(F.coalesce("text", F.lit("")), " ").alias("tokens"))
    padded = sequences.pad_batch(rows, ["conv_id"])
    return padded.select("conv_id", "turn", F.size("tokens").alias("padded"), F.aggregate("mask", F.lit(0), lambda s, x: s + x).alias("mask_sum"), F.element_at("tokens", -1).alias("last_token"))


@query("""
    SELECT o_orderkey, o_custkey AS token_id, CAST(len(embedding) AS INTEGER) AS n, round(list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * i)), 5) AS checksum
    FROM orders LEFT JOIN embeddings ON vec_id = o_custkey
""")
def embedding_lookup(spark, sf_dir):
    tokens = _table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").withColumnRenamed("o_custkey", "token_id")
    found = sequences.embedding_lookup(tokens, _table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    weighted = F.aggregate(F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return found.select("o_orderkey", "token_id", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("n"), F.round(weighted, 5).alias("checksum"))


@query("""
    WITH n AS (SELECT conv_id, length(text) AS v, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
    SELECT conv_id, CAST(max(v) FILTER (WHERE back = 2) AS INTEGER) AS value FROM n GROUP BY conv_id
""")
def penultimate_layer(spark, sf_dir):
    states = _table(spark, sf_dir, "conversations", "conv_id", "turn", F.length("text").alias("value"))
    return sequences.penultimate(states, ["conv_id"], "turn", "value")


@query("""
    SELECT conv_id, count(*) AS n_messages, CAST(sum(CASE WHEN role = 'user' THEN 2 ELSE 1 END) AS BIGINT) AS n_items, string_agg(role, ',' ORDER BY turn) AS roles, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY turn)) AS text_md5
    FROM conversations GROUP BY conv_id
""")
def chat_messages(spark, sf_dir):
    m = chat.messages(_table(spark, sf_dir, "conversations"), image_roles=("user",))
    items = F.aggregate("messages", F.lit(0).cast("bigint"), lambda s, x: s + F.size(x.content))
    text = F.array_join(F.transform("messages", lambda x: F.coalesce(F.element_at(x.content, -1)["text"], F.lit(""))), "\n")
    return m.select("conv_id", F.size("messages").cast("bigint").alias("n_messages"), items.alias("n_items"), F.array_join(F.transform("messages", lambda x: x.role), ",").alias("roles"), F.md5(text).alias("text_md5"))


@query("""
    SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || CASE WHEN role = 'user' THEN '<image>' || chr(10) ELSE '' END || coalesce(text, '') || chr(10), '' ORDER BY turn) || '<|assistant|>' || chr(10) AS prompt
    FROM conversations GROUP BY conv_id
""")
def chat_prompt(spark, sf_dir):
    m = chat.messages(_table(spark, sf_dir, "conversations"), image_roles=("user",))
    return m.select("conv_id", chat.prompt().alias("prompt"))


@query("""
    SELECT conv_id, turn, array_to_string(list_filter(string_split(coalesce(text, ''), ' '), lambda t: t NOT IN ('the', 'and'))[1:20], ' ') AS answer FROM conversations
""")
def decode_answers(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations", "conv_id", "turn", F.split(F.coalesce("text", F.lit("")), " ").alias("tokens"))
    return rows.select("conv_id", "turn", sequences.decode("tokens", ("the", "and"), 20).alias("answer"))


def _answers(spark, sf_dir) -> DataFrame:
    """(doc_id, tokens): each document's tokens, all of them."""
    return _table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", T.tokens("text").alias("tokens"))


_PREFIX_TOKENS = (20, 40, 60, 80, 100)


def _quality(spark, sf_dir) -> DataFrame:
    """(doc_id, k, f1): each document against its own beginnings, of four tokens a tile; all in one pass over the tokens."""
    scores = T.rouge_l_prefixes(F.col("tokens"), F.slice("tokens", 1, max(_PREFIX_TOKENS)), _PREFIX_TOKENS)
    each = _answers(spark, sf_dir).select("doc_id", F.posexplode(scores).alias("i", "f1"))
    return each.select("doc_id", ((F.col("i") + 1) * 5).alias("k"), "f1")


@query("""
    WITH runs AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'baseline' ELSE 'chunked' END AS method, event_id, ts, event_type, value FROM events),
    numbered AS (SELECT method, value, row_number() OVER (PARTITION BY method ORDER BY ts, event_id) AS n FROM runs WHERE event_type = 'purchase'),
    timed AS (SELECT method, count(*) AS n, avg(value) * 1000 AS mean_ms FROM numbered WHERE n > 1 GROUP BY method),
    reset AS (SELECT method, max(ts) AS last FROM runs WHERE event_type = 'signup' GROUP BY method),
    peak AS (SELECT r.method, max(value) * 1e7 / 1073741824 AS peak_gib FROM runs r LEFT JOIN reset USING (method) WHERE event_type <> 'signup' AND (last IS NULL OR ts >= last) GROUP BY r.method)
    SELECT method, n, round(mean_ms, 4) AS mean_ms, round(peak_gib, 6) AS peak_gib FROM timed LEFT JOIN peak USING (method)
""")
def method_comparison(spark, sf_dir):
    """Mean time after warm-up and peak memory since the last reset, by method; even users stand for one, odd for the other."""
    runs = _table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type", "value").withColumn("method", F.when(F.col("user_id") % 2 == 0, "baseline").otherwise("chunked"))
    timed = timing.timing_summary(runs.where("event_type = 'purchase'").withColumnRenamed("value", "elapsed_s"), ["method"], ["ts", "event_id"])
    peak = timing.peak_since_reset(runs, ["method"], F.col("event_type") == "signup", value="value")
    return timed.join(peak, "method", "left").select("method", "n", *_r("mean_ms", digits=4), F.round(F.col("peak") * 1e7 / 2**30, 6).alias("peak_gib"))


#: A prefix is a common subsequence as long as itself, so these scores need no table.
_PREFIX_SCORES = f"""t AS (SELECT doc_id, {_TOKENS} AS tokens FROM documents), p AS (SELECT doc_id, k, len(tokens) AS n, least(len(tokens), 4 * k) AS m FROM t, (SELECT unnest([5, 10, 15, 20, 25]) AS k)),
    s AS (SELECT doc_id, k, CASE WHEN n = 0 THEN 0.0 ELSE 2.0 * m / (n + m) END AS f1 FROM p)"""


@query(f"WITH {_PREFIX_SCORES} SELECT doc_id, k, round(f1, 6) AS f1 FROM s")
def rouge_l(spark, sf_dir):
    return _quality(spark, sf_dir).select("doc_id", "k", *_r("f1"))


@query(f"WITH {_PREFIX_SCORES} SELECT k, count(*) AS n, round(avg(f1), 6) AS f1 FROM s GROUP BY k")
def generation_quality(spark, sf_dir):
    return _quality(spark, sf_dir).groupBy("k").agg(F.count("*").alias("n"), F.round(F.avg("f1"), 6).alias("f1"))


@query(None)
def rouge_l_pairs(spark, sf_dir):
    """Each whole document against the one with the next doc_id, by an equi-join. Texts are joined before they become tokens, which are larger."""
    t = _table(spark, sf_dir, "documents", "doc_id", "text")
    after = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("candidate"))
    both = t.join(after, "doc_id").select("doc_id", T.tokens("text").alias("tokens"), T.tokens("candidate").alias("candidate"))
    return both.select("doc_id", F.round(T.rouge_l(F.col("tokens"), F.col("candidate")), 6).alias("f1"))


@query(None)
def rouge_l_stem(spark, sf_dir):
    """As rouge_l_pairs, on the stems of whole texts. Texts are joined before they become tokens, which are larger."""
    t = _table(spark, sf_dir, "documents", "doc_id", "text")
    after = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("candidate"))
    both = t.join(after, "doc_id").select("doc_id", T.tokens("text").alias("tokens"), T.tokens("candidate").alias("candidate"))
    return both.select("doc_id", F.round(T.rouge_l_stems(F.col("tokens"), F.col("candidate")), 6).alias("f1"))


@query("""
    WITH px AS (SELECT vec_id, k, list_transform(embedding, lambda x, i: CASE WHEN (i - 1) // 8 < 5 AND (i - 1) % 8 < 5 AND ((i - 1) // 8) * 5 + (i - 1) % 8 < k
                       THEN least(255, greatest(0, CAST(floor((CAST(x AS DOUBLE) + 1) * 127.5) AS INTEGER))) ELSE 0 END) AS p
                FROM embeddings, (SELECT unnest([1, 5, 10, 15, 20, 25]) AS k))
    SELECT vec_id, k, array_to_string(list_transform(p, lambda x: repeat(printf('%02X', x), 3)), '') AS pixels FROM px
""")
def tile_mask_image(spark, sf_dir):
    """Vectors as 8 x 8 images, tiles masked on the bytes."""
    rows = _table(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", images.raster_bytes("embedding").alias("data"), F.explode(F.array(*[F.lit(k) for k in X.PREFIXES])).alias("k"))
    return rows.select("vec_id", "k", F.hex(images.mask_prefix("data", F.lit(8), F.lit(8), "k")).alias("pixels"))


_PREFILL = """items AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, part) - 1 AS pos, part = 0 AS is_image,
        CASE WHEN part = 0 THEN 24 ELSE len(list_filter(string_split(coalesce(text, ''), ' '), lambda t: t <> '')) END AS len
        FROM conversations, (SELECT unnest([0, 1]) AS part) WHERE part = 1 OR role = 'user')"""


def _prefill(spark, sf_dir) -> DataFrame:
    return chat.prefill_items(chat.messages(_table(spark, sf_dir, "conversations"), image_roles=("user",)))


@query(f"WITH {_PREFILL} SELECT conv_id, CAST(pos AS INTEGER) AS pos, is_image, CAST(len AS INTEGER) AS len FROM items")
def prefill_items(spark, sf_dir):
    """What a prompt consists of: images and texts, told apart item by item."""
    return _prefill(spark, sf_dir)


@query(f"""
    WITH RECURSIVE {_PREFILL}, f AS (
        SELECT conv_id, pos, 0 AS chunk, len AS run, len FROM items WHERE pos = 0
        UNION ALL SELECT i.conv_id, i.pos, CASE WHEN f.run >= 64 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.run >= 64 THEN i.len ELSE f.run + i.len END, i.len
        FROM f JOIN items i ON i.conv_id = f.conv_id AND i.pos = f.pos + 1),
    c AS (SELECT conv_id, chunk, sum(len) AS len FROM f GROUP BY conv_id, chunk)
    SELECT conv_id, 'baseline' AS method, 1 AS calls, CAST(sum(len) AS BIGINT) AS longest, CAST(sum(len) AS BIGINT) AS cache_len FROM items GROUP BY conv_id
    UNION ALL SELECT conv_id, 'chunked', CAST(count(*) AS INTEGER), CAST(max(len) AS BIGINT), CAST(sum(len) AS BIGINT) FROM c GROUP BY conv_id
""")
def chunked_against_baseline(spark, sf_dir):
    """A prompt in one call, and in chunks that never split an image: calls, the longest of them, and the cache in the end."""
    items = _prefill(spark, sf_dir)
    chunks = sequences.greedy_chunks(items, 64, seq="conv_id")
    one = items.groupBy("conv_id").agg(F.lit("baseline").alias("method"), F.lit(1).alias("calls"), F.sum(F.col("len").cast("bigint")).alias("longest"), F.sum(F.col("len").cast("bigint")).alias("cache_len"))
    many = chunks.groupBy("conv_id").agg(F.lit("chunked").alias("method"), F.count("*").cast("int").alias("calls"), F.max("len").alias("longest"), F.max("cache_len").alias("cache_len"))
    return one.union(many)


@query("""
    WITH e AS (SELECT event_id, user_id, ts, event_type, value FROM events WHERE ts >= TIMESTAMP '2024-01-10'),
    called AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM e WHERE event_type = 'click'),
    runs AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM e WHERE event_type = 'purchase'),
    timed AS (SELECT user_id, count(*) AS n, avg(value) * 1000 AS mean_ms FROM runs WHERE n > 1 GROUP BY user_id)
    SELECT c.user_id, c.event_id AS captured, t.n, round(t.mean_ms, 4) AS mean_ms FROM called c LEFT JOIN timed t ON c.user_id = t.user_id WHERE c.n = 1
""")
def gated_run(spark, sf_dir):
    """Once the gate is open: the first call that it captures, and the mean time of the runs after a warm-up."""
    e = sequences.require(_table(spark, sf_dir, "events"), "event_id", "user_id", "ts", "event_type", "value")
    on = F.lit("2024-01-10").cast("timestamp_ntz")
    first = timing.first_after_enable(e.where("event_type = 'click'"), on, ["user_id"], ["ts", "event_id"])
    runs = e.where((F.col("event_type") == "purchase") & (F.col("ts") >= on)).withColumnRenamed("value", "elapsed_s")
    timed = timing.timing_summary(runs, ["user_id"], ["ts", "event_id"])
    return first.select("user_id", F.col("event_id").alias("captured")).join(timed, "user_id", "left").select("user_id", "captured", "n", *_r("mean_ms", digits=4))


@query("""
    WITH n AS (SELECT event_id, user_id, value * 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type = 'purchase')
    SELECT event_id, user_id, 'INFER_' || (i - 1) AS name, ms AS elapsed_ms, printf('Iteration %02d: %.2f ms', i - 1, ms) AS line FROM n
""")
def iteration_timing(spark, sf_dir):
    """Each run of a user by name, with the line that a report has for it."""
    at = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = _table(spark, sf_dir, "events").where("event_type = 'purchase'").withColumn("i", F.row_number().over(at) - 1).withColumn("elapsed_ms", F.col("value") * 1000)
    return n.select("event_id", "user_id", F.concat(F.lit("INFER_"), "i").alias("name"), "elapsed_ms", F.format_string("Iteration %02d: %s ms", "i", T.fixed("elapsed_ms", 2)).alias("line"))


@query(f"""
    WITH {_PREFIX} SELECT k, layer, 'Attention_Layer_' || layer AS attention, 'MLP_Layer_' || layer AS mlp, printf('Layer %02d: %.4f', layer, sim) AS line FROM sims
""")
def layer_report(spark, sf_dir):
    """Names of a layer's parts and a line of text for each similarity, whatever its sign."""
    line = F.format_string("Layer %02d: %s", F.col("layer"), T.fixed("sim", 4))
    return X.prefix_experiment(_embeddings(spark, sf_dir)).select("k", "layer", F.concat(F.lit("Attention_Layer_"), "layer").alias("attention"), F.concat(F.lit("MLP_Layer_"), "layer").alias("mlp"), line.alias("line"))


@query(f"""
    WITH {_PREFIX} SELECT layer, CAST(count(*) AS INTEGER) AS n, round(max(sim) FILTER (WHERE k = 1), 6) AS at_1, round(max(sim) FILTER (WHERE k = 25), 6) AS at_25, CAST(NULL AS DOUBLE) AS at_2 FROM sims GROUP BY layer
""")
def layer_series(spark, sf_dir):
    """Each layer's similarities as a map by k, and what it has for some k."""
    s = compare.series(X.prefix_experiment(_embeddings(spark, sf_dir)))
    at = lambda k: F.round(F.try_element_at("series", F.lit(k)), 6).alias(f"at_{k}")
    return s.select("layer", F.size("series").alias("n"), at(1), at(25), at(2))


@query("""
    WITH t AS (SELECT conv_id, turn, role, text, max(turn) FILTER (WHERE role = 'assistant') OVER (PARTITION BY conv_id) AS last FROM conversations),
    asked AS (SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || CASE WHEN role = 'user' THEN '<image>' || chr(10) ELSE '' END || coalesce(text, '') || chr(10), '' ORDER BY turn) || '<|assistant|>' || chr(10) AS prompt
              FROM t WHERE last IS NULL OR turn < last GROUP BY conv_id)
    SELECT a.conv_id, a.prompt, array_to_string(list_filter(string_split(coalesce(t.text, ''), ' '), lambda x: x NOT IN ('the', 'and'))[1:20], ' ') AS answer
    FROM asked a JOIN t ON t.conv_id = a.conv_id AND t.turn = t.last
""")
def single_inference(spark, sf_dir):
    """The prompt before a conversation's last answer, and the first answer of the batch of one, decoded."""
    turns = _table(spark, sf_dir, "conversations")
    last = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("last"))
    both = turns.join(last, "conv_id", "left")
    asked = chat.messages(both.where("last is null or turn < last"), image_roles=("user",)).select("conv_id", chat.prompt().alias("prompt"))
    batch = both.where("turn = last").groupBy("conv_id").agg(F.collect_list(F.split(F.coalesce("text", F.lit("")), " ")).alias("batch"))
    return asked.join(batch, "conv_id").select("conv_id", "prompt", sequences.decode(F.element_at("batch", 1), ("the", "and"), 20).alias("answer"))


@query("""
    SELECT user_id, round(max_by(value, (ts, event_id)) / 100, 6) AS current_gb, round(max(value) * 1e7 / 1073741824, 6) AS peak_gib FROM events GROUP BY user_id
""")
def gauge_readings(spark, sf_dir):
    """Memory by user: what it is now, in decimal GB, and its peak, in GiB; a unit of value is 10 MB."""
    g = _table(spark, sf_dir, "events", "user_id", "ts", "event_id", (F.col("value") * 1e7).alias("bytes"))
    return timing.gauge_readings(g, ["user_id"], F.struct("ts", "event_id")).select("user_id", *_r("current_gb", "peak_gib"))


_ORDERS = """req AS (SELECT o_orderkey AS req_id, o_orderpriority AS name, epoch_us(o_orderdate) / 1e6 AS arrival, min(epoch_us(l_shipdate)) / 1e6 AS first, max(epoch_us(l_shipdate)) / 1e6 AS last
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority, o_orderdate)"""


def _orders(spark, sf_dir) -> DataFrame:
    """Orders as requests whose phases are stored: the first line that is shipped is the first token, the last one the end."""
    lines = _table(spark, sf_dir, "lineitem", "l_orderkey", "l_shipdate").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))
    rows = _table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_orderdate").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    at = [seconds(c).alias(name) for c, name in (("o_orderdate", "arrival_time"), ("first", "first_token_time"), ("last", "end_time"))]
    return rows.select(F.col("o_orderkey").alias("req_id"), F.col("o_orderpriority").alias("name"), *at)


@query(f"""
    WITH {_ORDERS}, burst AS (SELECT *, min(arrival) OVER (PARTITION BY name) AS t0 FROM req)
    SELECT 'BURST_' || name AS name, count(*) AS n, round(avg(first - t0), 4) AS ttft_avg, round(quantile_cont(first - t0, 0.95), 4) AS ttft_p95, round(avg(last - t0), 4) AS latency_avg,
           round(quantile_cont(last - t0, 0.95), 4) AS latency_p95, round(count(*) * 20.0 / (max(last) - min(t0)), 9) AS throughput FROM burst GROUP BY name
""")
def burst_metrics(spark, sf_dir):
    """Orders of a priority as a burst that arrives with the first of them."""
    rows = _orders(spark, sf_dir)
    burst = rows.drop("arrival_time").join(rows.groupBy("name").agg(F.min("arrival_time").alias("arrival_time")), "name")
    m = serving.request_metrics(burst, ["name"])
    return m.select(F.concat(F.lit("BURST_"), "name").alias("name"), "n", *_r("ttft_avg", "ttft_p95", "latency_avg", "latency_p95", digits=4), *_r("throughput", digits=9))


@query(f"""
    WITH {_ORDERS}, m AS (SELECT avg(first - arrival) AS a, quantile_cont(first - arrival, 0.95) AS b, avg(last - arrival) AS c, quantile_cont(last - arrival, 0.95) AS d, count(*) * 20.0 / (max(last) - min(arrival)) AS e FROM req),
    told AS (SELECT ['================ RESULTS ================', printf('TTFT AVG      : %.4f s', a), printf('TTFT P95      : %.4f s', b), printf('Latency AVG   : %.4f s', c), printf('Latency P95   : %.4f s', d),
                     printf('Throughput    : %.2f tokens/s', e), '========================================='] AS lines FROM m)
    SELECT CAST(unnest(range(0, 7)) AS INTEGER) AS no, unnest(lines) AS line FROM told
""")
def metric_block(spark, sf_dir):
    """The report of a run whose requests are written at the same time."""
    metrics = serving.write_with_metrics(_orders(spark, sf_dir), tables.folder(spark, "served"))
    return serving.metric_block(spark, metrics)


@query(SQL["span_pairs"])
def trace_files(spark, sf_dir):
    """The ranges of span_pairs, written by the trace sink and read back."""
    spans = span_pairs(spark, sf_dir)
    folder = tables.folder(spark, "traces")
    traces.write_traces(spans, folder)
    return traces.read_traces(spark, folder, spans.schema)


@query(f"""
    WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(least(255, greatest(0, CAST(floor((CAST(x AS DOUBLE) + 1) * 127.5) AS INTEGER))) AS DOUBLE)) AS v FROM embeddings),
    m AS (SELECT vec_id, k, v, {_mask("k")} AS m FROM g, (SELECT unnest([1, 5, 10, 15, 20, 25]) AS k))
    SELECT vec_id, k, true AS same, md5(array_to_string(list_transform(m, lambda x: repeat(printf('%02X', CAST(x AS INTEGER)), 3)), '')) AS pixels_md5, round({_cos("m", "v")}, 6) AS sim FROM m
""")
def image_scan(spark, sf_dir):
    """Vectors written as image files; the files listed and decoded, compared with the vectors' bytes, masked, and compared with themselves."""
    rows = _table(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", images.raster_bytes("embedding").alias("raw"))
    folder = tables.folder(spark, "images")
    images.write_images(rows.select("vec_id", "raw", F.lit(8).alias("w"), F.lit(8).alias("h")), folder, "vec_id", "raw", "w", "h").write.format("noop").mode("overwrite").save()
    name = F.regexp_extract("image.origin", r"([^/]+)\.png$", 1).cast("bigint")
    found = images.read_images(spark, folder, False).select(name.alias("vec_id"), "image.data", "image.width", "image.height")
    both = found.join(rows, "vec_id").withColumn("k", F.explode(F.array(*[F.lit(k) for k in X.PREFIXES])))
    masked = both.withColumn("m", images.mask_prefix("data", "width", "height", "k"))
    return masked.select("vec_id", "k", (F.col("data") == F.col("raw")).alias("same"), F.md5(F.hex("m").cast("string")).alias("pixels_md5"), F.round(cosine(images.grey("m"), images.grey("data")), 6).alias("sim"))


@query(f"""
    WITH t AS (SELECT doc_id, {_TOKENS} AS tokens FROM documents), w AS (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM t),
    vocabulary AS (SELECT token, row_number() OVER (ORDER BY token) AS id FROM (SELECT DISTINCT token FROM w)),
    coded AS (SELECT doc_id, list(id ORDER BY pos) AS ids FROM w JOIN vocabulary USING (token) GROUP BY doc_id),
    batch AS (SELECT doc_id, tokens, coalesce(ids, []) AS ids, max(len(tokens)) OVER (PARTITION BY doc_id // 32) AS longest FROM t LEFT JOIN coded USING (doc_id))
    SELECT doc_id, CAST(len(ids) AS INTEGER) AS n, md5(array_to_string(list_resize(ids, longest, 0), ',')) AS ids_md5, md5(array_to_string(tokens, ' ')) AS text_md5 FROM batch
""")
def decode_ids(spark, sf_dir):
    """Texts as dense ids, padded to the longest of a batch of 32, and back."""
    rows = _answers(spark, sf_dir)
    words = vocabulary.build(rows)
    coded = vocabulary.encode(rows, words, ["doc_id"]).select("doc_id", "ids", F.floor(F.col("doc_id") / 32).alias("batch"))
    longest = F.max(F.size("ids")).over(Window.partitionBy("batch"))
    padded = coded.select("doc_id", F.size("ids").alias("n"), F.concat("ids", F.array_repeat(F.lit(0).cast("bigint"), longest - F.size("ids"))).alias("ids"))
    padded = tables.save(padded, "padded")  # decode reads it twice
    out = vocabulary.decode(padded, words, ["doc_id"])
    return out.select("doc_id", "n", F.md5(F.array_join("ids", ",")).alias("ids_md5"), F.md5("text").alias("text_md5"))


@query(f"""
    WITH RECURSIVE {_PREFILL}, f AS (
        SELECT conv_id, pos, 0 AS chunk, len AS run, len FROM items WHERE pos = 0
        UNION ALL SELECT i.conv_id, i.pos, CASE WHEN f.run >= 64 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.run >= 64 THEN i.len ELSE f.run + i.len END, i.len
        FROM f JOIN items i ON i.conv_id = f.conv_id AND i.pos = f.pos + 1),
    c AS (SELECT conv_id, chunk, sum(len) AS len FROM f GROUP BY conv_id, chunk),
    work AS (SELECT conv_id, 'baseline' AS method, 1 AS calls, CAST(sum(len) AS BIGINT) AS longest FROM items GROUP BY conv_id
             UNION ALL SELECT conv_id, 'chunked', CAST(count(*) AS INTEGER), CAST(max(len) AS BIGINT) FROM c GROUP BY conv_id),
    runs AS (SELECT user_id, CASE event_type WHEN 'view' THEN 'baseline' ELSE 'chunked' END AS method, ts, event_id, value FROM events WHERE event_type IN ('view', 'click')),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id, method ORDER BY ts, event_id) AS n FROM runs),
    timed AS (SELECT user_id, method, count(*) AS n, avg(value) * 1000 AS mean_ms FROM numbered WHERE n > 1 GROUP BY user_id, method),
    reset AS (SELECT user_id, max(ts) AS last FROM events WHERE event_type = 'error' GROUP BY user_id),
    peak AS (SELECT user_id, method, max(value) * 1e7 / 1073741824 AS peak_gib FROM runs LEFT JOIN reset USING (user_id) WHERE last IS NULL OR ts >= last GROUP BY user_id, method)
    SELECT conv_id, w.method, calls, longest, t.n, round(mean_ms, 4) AS mean_ms, round(peak_gib, 6) AS peak_gib
    FROM work w LEFT JOIN timed t ON t.user_id = conv_id AND t.method = w.method LEFT JOIN peak p ON p.user_id = conv_id AND p.method = w.method
""")
def prefill_methods(spark, sf_dir):
    """A prompt in one call and in chunks, with each method's mean time after a warm-up and its peak memory since the last reset.

    The runs of a prompt are the events of the user with its number: views run the baseline, clicks the chunks, errors reset the peak.
    """
    work = chunked_against_baseline(spark, sf_dir).drop("cache_len")
    events = _table(spark, sf_dir, "events", "event_id", F.col("user_id").alias("conv_id"), "ts", "event_type", "value")
    method = F.when(F.col("event_type") == "view", "baseline").when(F.col("event_type") == "click", "chunked")
    runs = events.withColumn("method", method).where("method is not null")
    timed = timing.timing_summary(runs, ["conv_id", "method"], ["ts", "event_id"], value="value")
    both = F.explode(F.when(F.col("event_type") == "error", F.array(F.lit("baseline"), F.lit("chunked"))).otherwise(F.array(method))).alias("method")
    gauges = events.where("event_type in ('view', 'click', 'error')").select("conv_id", "ts", "event_type", "value", both)
    peak = timing.peak_since_reset(gauges, ["conv_id", "method"], F.col("event_type") == "error", value="value")
    found = work.join(timed, ["conv_id", "method"], "left").join(peak, ["conv_id", "method"], "left")
    return found.select("conv_id", "method", "calls", "longest", "n", *_r("mean_ms", digits=4), F.round(F.col("peak") * 1e7 / 2**30, 6).alias("peak_gib"))


@query("SELECT label AS layer, unnest(['Embedding_Layer_' || label, 'Layer_' || label || '_Label']) AS name FROM (SELECT DISTINCT label FROM embeddings)")
def module_names(spark, sf_dir):
    """Names of the parts that each layer has; the table has no attention, so there is no name for it."""
    parts = {"embedding": "Embedding_Layer_{}", "attention": "Attention_Layer_{}", "label": "Layer_{}_Label"}
    return timing.named_parts(_embeddings(spark, sf_dir), "label", parts)


def _model_inputs(spark, sf_dir, ks) -> DataFrame:
    rows = _embeddings(spark, sf_dir).select(F.col("vec_id").alias("b"), "embedding", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    return rows.select("b", "k", keep_prefix("embedding", "k").alias("vec"))


@query(None)
def model_prefix_similarity(spark, sf_dir):
    """States of a network for masked inputs against those for whole ones, by layer."""
    full = network.hidden_states(_embeddings(spark, sf_dir).select(F.col("vec_id").alias("b"), F.lit(0).alias("k"), F.col("embedding").alias("vec")))
    return compare.compare_layers(network.hidden_states(_model_inputs(spark, sf_dir, X.PREFIXES)), full.drop("k"))


@query(None)
def model_incremental_similarity(spark, sf_dir):
    """States of a network for k tiles against those for k - 1, by layer."""
    return compare.compare_incremental(network.hidden_states(_model_inputs(spark, sf_dir, range(1, 26))))


@query(None)
def model_kv_similarity(spark, sf_dir):
    """Caches of a network, which grow with the tiles, against those of the step before, by layer."""
    rows = _model_inputs(spark, sf_dir, range(1, 26)).withColumn("n", F.floor(F.col("k") * 7 / 25).cast("int") + 1)
    return compare.compare_kv(network.kv_cache(rows, "n"))
