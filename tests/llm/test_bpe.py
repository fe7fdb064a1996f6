import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tilewise.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RAW = open(PATH, "rb").read()
RANKS = bpe.read_ranks(RAW)
OTHER = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bpe.codec(RAW, P.PATTERN)


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text(text):
    ids = CODEC.encode(text)
    assert ids == OTHER.encode_ordinary(text) and CODEC.decode(ids, 3) == text.encode()


def test_crowded_texts():
    rnd = random.Random(0)
    parts = ["th", "er", "ö", "ß", " ", "  ", "\n", "é", "12", "'s", "'", "ing", "tion", "東", "🎉", "q", "Z", "*", "%%%", "\u0301", "e"]
    for text in ["a" * 500, "ab" * 300, "<|endoftext|>", *("".join(rnd.choices(parts, k=rnd.randrange(1, 60))) for _ in range(1000))]:
        assert CODEC.encode(text) == OTHER.encode_ordinary(text)


def test_small_tables(monkeypatch):
    monkeypatch.setattr(bpe, "STATES", 20)
    monkeypatch.setattr(bpe, "BORDERS", 5)
    monkeypatch.setattr(bpe, "CHUNKS", 3)
    monkeypatch.setattr(bpe, "BLOCK", 7)
    monkeypatch.setattr(bpe, "LOOK", 4)
    c = bpe.Codec(RANKS, P.PATTERN)
    text = "The reordering of internationalisation, überhaupt; 12345 " * 5
    assert c.encode(text) == OTHER.encode_ordinary(text)


def test_transducer_is_the_definition():
    rnd = random.Random(1)
    for _ in range(300):
        piece = bytes(rnd.choice(b"thering \xc3\xa9") for _ in range(rnd.randrange(1, 25)))
        assert CODEC.machine.encode(piece) == CODEC.machine.merge(piece)


def test_many_pieces_at_once():
    rnd = random.Random(2)
    pieces = list({bytes(rnd.choice(b"thering \xc3\xa9\xff0") for _ in range(rnd.randrange(1, bpe.LOOK + 1))) for _ in range(2000)})
    assert CODEC.packed.encode(pieces) == [CODEC.machine.merge(p) for p in pieces] and CODEC.packed.encode([]) == []


def test_pieces_longer_than_the_lookahead():
    rnd = random.Random(3)
    for letters in ("a", "ab", "thering", "é東a", " ", "=-"):
        text = "".join(rnd.choice(letters) for _ in range(700))
        assert CODEC.encode(text) == OTHER.encode_ordinary(text)


def test_white_space_between_chunks():
    rnd = random.Random(4)
    for _ in range(2000):
        text = "".join(rnd.choice([" ", " ", "\n", "\t", "\u00a0", "\u2003", "\x1c", "\x85", "\r", "a", "B1", "'s", "!", "\u200b"]) for _ in range(rnd.randrange(1, 14)))
        assert CODEC.encode(text) == OTHER.encode_ordinary(text)


def test_another_pattern():
    c = bpe.Codec(RANKS, r"\p{L}+|\d{1,3}|[^\p{L}\d]+")
    other = tiktoken.Encoding("other", pat_str=r"\p{L}+|\d{1,3}|[^\p{L}\d]+", mergeable_ranks=RANKS, special_tokens={})
    text = "überall 123456 words,  and more\n\nof them " * 20
    assert c.encode(text) == other.encode_ordinary(text)


def test_long_and_repeated_texts_in_one_batch(spark):
    long = "the quick brown fox, " * 40_000
    df = spark.createDataFrame([(1, "a b"), (2, long), (3, "a b"), (4, ""), (5, None)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in bpe.tokenize(df, PATH, P.PATTERN, out=bpe.tokens() | bpe.digests()).collect()}
    assert got[2].tokens == OTHER.encode_ordinary(long) and got[1].tokens == got[3].tokens == OTHER.encode_ordinary("a b")
    assert got[2].ids_sha256 == hashlib.sha256(",".join(map(str, got[2].tokens)).encode()).hexdigest()
    assert got[2].decoded_sha256 == hashlib.sha256(long.encode()).hexdigest() and got[4].n_tokens == got[5].n_tokens == 0


@given(st.binary(max_size=40), st.lists(st.integers(1, 5), max_size=40))
@settings(max_examples=300, deadline=None)
def test_utf8_stream(data, cuts):
    s, out, at = bpe.Utf8Stream(), "", 0
    for n in cuts:
        out += s.feed(data[at : at + n])
        at += n
    assert out + s.feed(data[at:]) + s.close() == data.decode("utf-8", "replace")


def test_rows_of_all_kinds(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "hello world", "c"), (3, "hello world", "c"), (None, "x" * 100_000, None)], "doc_id long, text string, tokens string")
    rows = bpe.tokenize(df, PATH, P.PATTERN).collect()
    n = len(OTHER.encode_ordinary("hello world"))
    assert sorted(len(r.tokens) for r in rows)[:4] == [0, 0, n, n] and len(rows) == 5
    assert bpe.tokenize(df.limit(0), PATH, P.PATTERN).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in bpe.op7_bpe(spark, d).collect():
        ids = OTHER.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())


def test_bytes_that_are_no_utf8():
    s = bpe.Utf8Stream()
    assert s.feed(b"\xe2\x82") == "" and s.feed(b"\xac!") == "€!" and s.feed(b"\xf0\x9f") == "" and s.close() == "\ufffd"
    with pytest.raises(KeyError):
        CODEC.decode([99_999_999])
