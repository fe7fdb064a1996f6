import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilewise.functions import text as T
from tilewise.operators import chat, sequences


def chunks(spark, lengths, size):
    items = spark.createDataFrame([(1, i, n) for i, n in enumerate(lengths)], "seq_id int, pos int, len int")
    return [(r.len, r.n_items, r.cache_len) for r in sequences.greedy_chunks(items, size).orderBy("chunk").collect()]


def test_greedy_chunks(spark):
    one = [1] * 5 + [7] + [1] * 12
    assert [c[0] for c in chunks(spark, one, 6)] == [12, 6, 6]
    assert chunks(spark, [4, 4, 1], 6) == [(8, 2, 8), (1, 1, 9)]
    assert chunks(spark, [], 6) == []


def test_greedy_chunks_against_a_loop(spark):
    rnd = random.Random(0)
    rows = [(s, i, rnd.randrange(0, 9)) for s in range(20) for i in range(rnd.randrange(1, 30))]
    want = []
    for s in range(20):
        run, n, c = 0, 0, 0
        for _, _, length in [r for r in rows if r[0] == s]:
            run, n = run + length, n + 1
            if run >= 10:
                want.append((s, c, n, run))
                run, n, c = 0, 0, c + 1
        if n:
            want.append((s, c, n, run))
    got = sequences.greedy_chunks(spark.createDataFrame(rows, "seq_id int, pos int, len int"), 10).collect()
    assert sorted(tuple(r)[:4] for r in got) == want


def test_padding(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (1, ["d"]), (2, ["e"])], "b int, tokens array<string>")
    got = {tuple(r.tokens): tuple(r["mask"]) for r in sequences.pad_batch(df, ["b"]).collect()}
    assert got == {("a", "b", "c"): (1, 1, 1), ("d", "<pad>", "<pad>"): (1, 0, 0), ("e",): (1,)}


def test_order_lookup_penultimate_decode(spark):
    parts = spark.createDataFrame([(1, 2, [3]), (1, 1, [1, 2])], "g int, o int, v array<int>")
    assert sequences.concat_ordered(parts, ["g"], "o", "v").first().v == [1, 2, 3]
    assert [r.v for r in sequences.penultimate(spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, "x")], "g int, l int, v string"), ["g"], "l", "v").orderBy("g").collect()] == ["b", None]
    table = spark.createDataFrame([(1, [1.0])], "vec_id int, embedding array<float>")
    assert [r.embedding for r in sequences.embedding_lookup(spark.createDataFrame([(1,), (2,)], "token_id int"), table).orderBy("token_id").collect()] == [[1.0], None]
    assert spark.createDataFrame([(["<s>", "a", "b", "c"],)], "t array<string>").select(sequences.decode("t", ("<s>",), 2)).first()[0] == "a b"


def test_chat(spark):
    turns = spark.createDataFrame([(1, 1, "assistant", "yes"), (1, 0, "user", "see?"), (2, 0, "user", None)], "conv_id int, turn int, role string, text string")
    m = chat.messages(turns, image_roles=("user",))
    assert m.schema["messages"].dataType.simpleString() == chat.SCHEMA
    assert [r.p for r in m.orderBy("conv_id").select(chat.prompt().alias("p")).collect()] == ["<|user|>\n<image>\nsee?\n<|assistant|>\nyes\n<|assistant|>\n", "<|user|>\n<image>\n\n<|assistant|>\n"]


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@given(st.lists(st.sampled_from("abc"), max_size=80), st.lists(st.sampled_from("abc"), max_size=80))
@settings(max_examples=200, deadline=None)
def test_lcs(a, b):
    assert T.lcs(a, b) == brute_lcs(a, b)


@pytest.mark.parametrize("a, b, want", [("the cat sat on the mat", "the dog sat on a mat", 2 / 3), ("", "x", 0.0), ("", "", 0.0), ("Same, same!", "same SAME", 1.0), (None, "x", 0.0)])
def test_rouge(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(T.rouge_l(T.tokens("a"), T.tokens("b"))).first()[0] == pytest.approx(want)


#: Examples from the description of Porter's algorithm.
STEMS = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "triplicate": "triplic", "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow", "adjustment": "adjust", "adoption": "adopt", "effective": "effect", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll"}


@pytest.mark.parametrize("word, want", STEMS.items())
def test_stem(word, want):
    assert T.stem(word) == want


def test_stems_leave_short_tokens(spark):
    assert spark.createDataFrame([(["was", "running", "dogs"],)], "t array<string>").select(T.stems(F.col("t"))).first()[0] == ["was", "run", "dog"]


def test_few_rows_of_a_batch_are_objects_at_once(monkeypatch):
    """A batch has up to 10,000 texts; as lists of strings they take ten times their bytes."""
    import pyarrow as pa

    most = []

    class Column:
        def __init__(self, x):
            self.x = x

        def __len__(self):
            return len(self.x)

        def slice(self, at, n):
            most.append(n)
            return self.x.slice(at, n)

    column = pa.array([["running", "dogs", "was"]] * 1000 + [[]], pa.list_(pa.string()))
    got = T.by_rows(lambda row: [T.stem(w) for w in row], pa.list_(pa.string()), Column(column))
    assert max(most) <= 64 and got.to_pylist() == [["run", "dog", "wa"]] * 1000 + [[]]
    assert T.by_rows(len, pa.int32(), column.slice(0, 0)).to_pylist() == []
