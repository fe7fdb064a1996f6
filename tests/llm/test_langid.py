import random
import zlib

import numpy as np
import pytest

from tilewise.llm import langid as L

SETS = {"en": ["the", "thing", "with", "reading", "nation"], "fr": ["le", "oiseau", "été", "nation", "avec"], "ru": ["это", "слово", "дом"], "el": ["λόγος", "και"]}


@pytest.fixture(scope="module")
def model(spark):
    rnd = random.Random(0)
    rows = [(i, " ".join(rnd.choices(SETS[l], k=30)), l) for i, l in enumerate(rnd.choices(list(SETS), k=200))]
    return L.fit(spark.createDataFrame([*rows, (900, None, "en"), (901, "the", None)], "doc_id long, text string, lang string"))


def plain(model, text):
    """Viterbi word by word."""
    s, start, end, letters = model.words(text)
    if not letters.sum():
        return "und", 0.0
    v, back = s[0].astype(float), []
    for row in s[1:]:
        best = int(v.argmax())
        turn = v < v[best] - L.SWITCH
        back.append([best if t else i for i, t in enumerate(turn)])
        v = np.maximum(v, v[best] - L.SWITCH) + row
    path = [int(v.argmax())]
    for b in reversed(back):
        path.append(b[path[-1]])
    w = np.bincount(path[::-1], letters, len(model.langs))
    return model.langs[int(w.argmax())], float(w.max() / w.sum())


def test_viterbi_in_blocks_is_viterbi(model, monkeypatch):
    rnd = random.Random(1)
    texts = [None, "", "123 !", "x"] + [" ".join(rnd.choices(SETS[rnd.choice(list(SETS))] + SETS["en"], k=rnd.randrange(1, 60))) for _ in range(80)]
    want = [plain(model, t or "") for t in texts]
    assert [(a, pytest.approx(b)) for a, b, _ in model.label(texts)] == want
    monkeypatch.setattr(L, "BLOCK", 16)
    monkeypatch.setattr(L, "CELLS", 64)
    assert [(a, pytest.approx(b)) for a, b, _ in model.label(texts)] == want


def test_spans(model):
    text = "the thing with reading the thing. это слово дом это слово 12"
    lang, score, spans = model.label([text])[0]
    assert lang == "en" and 0.5 < score < 0.7
    assert [(text[a:b].split()[0], l) for a, b, l in spans] == [("the", "en"), ("это", "ru")]


def test_script_narrows(model):
    assert model.label(["ελλάδα"])[0][0] == "el" and model.label(["щщщ"])[0][0] == "ru"


def test_rows_of_all_kinds(spark, model):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "the thing", "c"), (3, "the thing", "c"), (None, "αβγ " * 50_000, None), (4, "١٢٣", "d")], "doc_id long, text string, score string")
    got = L.predict(df, model, spans=True).collect()
    assert sorted((r.doc_id or 0, r.lang_pred, r.score) for r in got) == [(0, "el", 1.0), (1, "und", 0.0), (2, "und", 0.0), (3, "en", 1.0), (3, "en", 1.0), (4, "und", 0.0)]
    none = L.fit(df.limit(0).withColumnRenamed("score", "lang"))
    assert {r.lang_pred for r in L.predict(df, none).collect()} == {"und"} and L.predict(df.limit(0), model).count() == 0


def test_query_on_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    got = L.op10_langid(spark, d).collect()
    assert len(got) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id] for r in held]) > 0.97
