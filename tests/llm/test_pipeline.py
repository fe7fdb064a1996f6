import hashlib

import public_tokenizers as P
import tiktoken

import corpus_pipeline as C
from tilewise.llm import bpe, langid
from tests.llm.test_jaccard import groups
from tests.llm.test_suffix_dedup import brute

D = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, out = docs.columns, {}
    for name, stage in C.STAGES:
        docs = stage(spark, docs, D)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out[name] = docs
        if name != "tokens":
            assert docs.columns == columns
    raw = {r.doc_id: r for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    kept = {r.doc_id for r in out["language"].collect()}
    model = langid.fit(spark.read.parquet(f"{D}/documents.parquet").where(~langid.held_out()))
    ids = sorted(raw)
    assert kept == {i for i, (l, s, _) in zip(ids, model.label([raw[i].text for i in ids])) if l != "und" and s >= C.LEAST_SHARE}
    ids = sorted(kept)
    label = groups([raw[i].text for i in ids])
    one = [d for k, d in enumerate(ids) if label[k] == k]
    assert sorted(r.doc_id for r in out["near_copies"].collect()) == one
    want = {d: t.decode("utf-8", "replace") for d, t in brute([(d, raw[d].text.encode()) for d in one], 50).items()}
    assert {r.doc_id: r.text for r in out["repeats"].collect()} == want
    mixed = out["mixture"].collect()
    assert {(r.doc_id, r.text) for r in mixed} <= set(want.items())
    sizes = sum(len(t.split()) for t in want.values())
    assert abs(sum(len(r.text.split()) for r in mixed) / sizes - 1.5) < 0.1
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read()), special_tokens={})
    tokens = out["tokens"].collect()
    assert len(tokens) == len(mixed)
    for r in tokens[:50]:
        assert r.tokens == other.encode_ordinary(want[r.doc_id]) and r.decoded_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()


def test_run_and_odd_rows(spark):
    assert C.run(spark, D).count() > 0
    rows = [(None, "the thing of the and", "en", "s", 1), (1, None, None, None, None), (1, "", "en", "s", 0), (2, "the and of the thing", "en", None, 9), (2, "the and of the thing", "en", None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for some in (docs, docs.limit(0)):
        for _, stage in C.STAGES:
            some = stage(spark, some, D)
        some.count()


KIND = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, Score double, _lang string"


def test_language_of_odd_rows(spark):
    whole = spark.read.parquet(f"{D}/documents.parquet")
    english = [r.text for r in whole.where("lang = 'en' and n_chars > 200").orderBy("doc_id").limit(3).collect()]
    german = [r.text for r in whole.where("lang = 'de' and n_chars > 200").orderBy("doc_id").limit(1).collect()]
    rows = [(i, t, "en", "s", 1, "x", 0.5, "y") for i, t in enumerate(english * 3)] + [(20, german[0], "de", None, None, None, None, None), (21, english[0] * 60, None, "s", 1, "x", None, None)]
    odd = [(30, None, "en", "s", 1, None, None, None), (31, "", "en", "s", 1, None, None, None), (32, "1234 -- !!", "en", "s", 1, None, None, None), (None, english[1], None, None, None, None, None, None), (21, english[2], "en", "s", 1, None, None, None)]
    docs = spark.createDataFrame(rows + odd, KIND).repartition(3)
    out = C.language(spark, docs, D)
    assert out.columns == docs.columns
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [*rows, *odd[3:]]))


def test_survivors_by_a_fixed_order(spark):
    rows = [(1, "one text that several rows have and that is long enough for shingles", "en", f"s{i % 4}", i, None, None, None) for i in range(40)]
    rows += [(2, "One text that several rows have and that is long enough for shingles", "en", "s9", 7, None, None, None), (None, None, None, None, None, None, None, None), (3, "", "en", "b", 1, None, None, None), (3, "", "en", "a", 2, None, None, None)]
    found = {tuple(sorted(map(str, map(tuple, C.near_copies(spark, spark.createDataFrame(rows, KIND).repartition(n), D).collect())))) for n in (1, 3, 8)}
    assert found == {tuple(sorted(map(str, [rows[0], rows[41], rows[43]])))}


def test_mixture_of_odd_rows(spark):
    rows = [(i, "a b c d", "en", "s", 1, None, None, None) for i in range(10)] + [(90, None, "en", "s", 1, None, None, None), (91, " \n", "en", "s", 1, None, None, None), (None, "x y", None, None, 1, None, None, None), (5, "a b c d", "en", "s", 1, None, None, None)]
    out = C.mixture(spark, spark.createDataFrame(rows, KIND), D).collect()
    words = {s: sum(len(r.text.split()) for r in out if r.source == s) for s in ("s", None)}
    # 46 words shared 69: weights 3 and 1, at most 88 and 4
    assert words == {"s": 64, None: 4} and {tuple(r) for r in out} <= set(rows) and not {90, 91} & {r.doc_id for r in out}


def test_tokens_of_odd_rows(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(open(path, "rb").read()), special_tokens={})
    texts = [None, "", "Ünï 日本 \u0000 x", "same", "same", "word " * 40_000]
    rows = [(i if i != 3 else None, t, "en", None, 1, None, None, None) for i, t in enumerate(texts)]
    got = C.tokens(spark, spark.createDataFrame(rows, KIND).repartition(2), D).collect()
    want = [(r[0], other.encode_ordinary(r[1] or ""), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows]
    assert sorted(((r.doc_id, list(r.tokens), r.decoded_sha256) for r in got), key=str) == sorted(want, key=str)
    assert all(r.ids_sha256 == hashlib.sha256(",".join(map(str, r.tokens)).encode()).hexdigest() and r.n_tokens == len(r.tokens) for r in got)
