import random

import corpus_pipeline as C
import numpy as np
import pyarrow as pa
from tilewise.llm import jaccard as J
from tilewise.llm.components import hook

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def groups(texts, size=5):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))})
    i, j = zip(*((i, j) for i in range(len(sets)) for j in range(len(sets)) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])))
    return hook(np.arange(len(texts)), np.array(i), np.array(j))


def edited(rnd, words, n):
    out = list(words)
    for at in rnd.sample(range(len(out)), n):
        out[at] = f"new{rnd.randrange(10**6)}"
    return " ".join(out)


def test_near_copies_are_those_of_brute_force_jaccard(spark):
    rnd = random.Random(0)
    texts = []
    for _ in range(12):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(60, 300))]
        texts += [" ".join(words)] + [edited(rnd, words, max(1, round(len(words) * share))) for share in (0.005, 0.01, 0.015, 0.02, 0.025, 0.03)]
    crowd = [f"c{rnd.randrange(5000)}" for _ in range(200)]
    texts += [edited(rnd, crowd, n) for n in (1, 2, 3, 4, 5) for _ in range(15)] + ["short text", "Short  text", "short texts", "", None]
    rnd.shuffle(texts)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], KIND).repartition(4)
    label = groups(texts)
    assert sorted(r.doc_id for r in C.near_copies(spark, docs, "").collect()) == [i for i in range(len(texts)) if label[i] == i]


def test_a_copy_goes_and_other_rows_of_its_id_stay(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(3, a, "1"), (5, a, "2"), (5, b, "3"), (7, c, "4"), (7, c, "4"), (7, f"{c} more", "5"), (None, a, "6"), (None, a, "6"), (8, None, "7"), (9, "", "8"), (2, d, "9"), (1, d.upper(), "10")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string").repartition(3)
    out = J.keep_first(df)
    assert out.columns == df.columns
    assert sorted(r.h for r in out.collect() if r.h not in "45") == sorted(["1", "3", "6", "6", "7", "10"])
    assert len([r for r in out.collect() if r.doc_id == 7]) == 1
    assert J.keep_first(df.limit(0)).count() == 0


def test_near_copies_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    label = groups([t for _, t in rows])
    assert sorted(r.doc_id for r in C.near_copies(spark, docs, "").collect()) == [rows[i][0] for i in range(len(rows)) if label[i] == i]


def test_blocks_of_a_long_text(monkeypatch):
    from tilewise.llm import simhash

    text = "one two three four five six seven eight nine ten"
    want = J.shingles(text).tolist()
    monkeypatch.setattr(simhash, "TEXT_BLOCK", 3)
    assert J.shingles(text).tolist() == want and len(want) == 6
    assert len(J.shingles("a bc d")) == 1


def test_bitmaps_differ_in_no_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(0)
    for n in (1, 63, 64, 65, 400, 3000):
        x = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
        y = np.unique(np.concatenate([x[: len(x) * 9 // 10], rng.integers(-(2**63), 2**63 - 1, max(1, n // 5))]))
        assert J.apart(J.bitmap(x), J.bitmap(x)) == 0
        assert J.apart(J.bitmap(x), J.bitmap(y)) <= len(np.setxor1d(x, y))


def test_crowded_shingles_lose_no_pair(spark, monkeypatch):
    """Every shingle that more than two nodes deal is split by second shingles, then in parts; common ones skip buckets."""
    rnd = random.Random(1)
    stock = [" ".join(f"l{k}x{i}" for i in range(12)) for k in range(25)]
    texts = [" ".join(rnd.sample(stock, 6)) for _ in range(60)]
    texts += [edited(rnd, t.split(), n) for t in texts[:30] for n in (1, 2)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], KIND).repartition(4)
    label = groups(texts)
    want = [i for i in range(len(texts)) if label[i] == i]
    monkeypatch.setattr(J, "BITS", 0)
    monkeypatch.setattr(J, "HOT", 8)
    sizes, pairs = [], J._lists

    def lists(shared, once):
        out = pairs(shared, once)
        sizes.append(out.groupBy("token", "block").count().agg({"count": "max"}).first()[0])
        return out

    monkeypatch.setattr(J, "_lists", lists)
    for crowd in (2, 1024):
        monkeypatch.setattr(J, "CROWD", crowd)
        assert sorted(r.doc_id for r in C.near_copies(spark, docs, "").collect()) == want, crowd
    assert sizes[0] < sizes[1]


def test_sets_similar_enough_share_two_shingles_of_their_prefixes():
    rng, none = np.random.default_rng(1), np.zeros(0, np.int64)
    for n in (4, 5, 9, 10, 50, 301):
        for _ in range(50):
            x = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
            y = np.delete(x, rng.choice(n, n - -(-4 * n // 5), replace=False))
            assert len(np.intersect1d(J.prefix(x, none, none, 2), J.prefix(y, none, none, 2))) >= 2


def listed(members, token, two=False, bits=None):
    """A batch of one list of (node, size, component, part, first shingles), with bitmaps if given."""
    names = ["node", "size", "component", "part", "firsts"]
    rows = [dict(zip(names, m)) | ({"bits": bits[m[0]]} if bits else {}) for m in members]
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] + ([pa.binary()] if bits else [])
    kind = pa.struct(list(zip([*names, "bits"], kinds)))
    return pa.RecordBatch.from_arrays([pa.array([rows], pa.list_(kind)), pa.array([token]), pa.array([two]), pa.array([0])], names=["m", "token", "two", "block"])


def test_a_pair_is_tested_where_it_meets_first():
    rng = np.random.default_rng(2)
    order = rng.permutation(10**6)[:40].astype(np.int32)  # of all shingles
    sets = {}
    for node in range(50):
        some = order[np.sort(rng.choice(40, rng.integers(3, 30), replace=False))]
        sets[node] = some
    bits = {node: J.bitmap(np.arange(100)) for node in sets}
    tests, pairs = 0, set()
    for t in order.tolist():
        members = [(n, 100, n, 0, s[: J.FIRST].tolist()) for n, s in sets.items() if t in s]
        if len(members) > 1:
            found = [p for b in J._pairs(iter([listed(members, t, bits=bits)])) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            met = [n for b in J._meet(iter([listed(members, t)])) for n in b.column("node").to_pylist()]
            assert sorted(met) == sorted({n for p in found for n in p})
            tests, pairs = tests + len(found), pairs | set(found)
    want = {(a, b) for a in sets for b in sets if a < b and np.isin(sets[a], sets[b]).any()}
    assert pairs == want  # none is lost
    shared = sum(np.isin(sets[a], sets[b]).sum() for a, b in want)
    assert tests < len(want) * 1.5 < shared / 2


def test_a_pair_of_a_crowded_shingle_is_tested_in_one_list_of_two():
    tokens = np.arange(1, 13, dtype=np.int32)
    bits = {n: J.bitmap(np.arange(100)) for n in range(20)}
    members = [(n, 100, n, 0, tokens[: J.FIRST].tolist()) for n in range(20)]
    n = 0
    for i, u in enumerate(tokens.tolist()):
        for v in tokens[i + 1 :].tolist():
            n += sum(b.num_rows for b in J._pairs(iter([listed(members, u << 32 | v, True, bits)])))
    assert n == 190


def test_bitmaps_tell_large_sets_apart_in_lists():
    """Sets of 3,000 shingles that share little differ in fewer bits of 512 than similar ones may."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(-(2**63), 2**63 - 1, n)) for n in (1000, 1030, 3000, 3100, 3200, 600)]
    sets.append(np.unique(np.concatenate([sets[2][:2990], rng.integers(-(2**63), 2**63 - 1, 20)])))
    sets.append(np.unique(np.concatenate([sets[0], rng.integers(-(2**63), 2**63 - 1, 40)])))  # another length of bitmap
    bits = {i: J.bitmap(s) for i, s in enumerate(sets)}
    members = [(i, len(s), i, 0, [7]) for i, s in enumerate(sets)]
    found = [p for b in J._pairs(iter([listed(members, 7, bits=bits)])) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert sorted(found) == [(0, 7), (2, 6)]


def test_places_bound_the_sizes_of_partners():
    """Lists of whole prefixes whose members have the most shingles of a partner find every similar pair, and test fewer."""
    rng, order = np.random.default_rng(4), np.random.default_rng(5).permutation(10**6)[:3000].astype(np.int32)
    rank, sets = {t: i for i, t in enumerate(order.tolist())}, []
    for _ in range(8):
        base = rng.choice(order, rng.integers(40, 90), replace=False)
        for n in rng.integers(0, 12, 12):  # sizes differ, too
            keep = rng.permutation(base)[n:]
            sets.append(sorted({*keep.tolist(), *rng.choice(order, rng.integers(0, 8)).tolist()}, key=rank.get))
    heads = [s[: len(s) - -(-J.NUM * len(s) // J.DEN) + 1] for s in sets]
    kind = pa.struct([*((k, pa.int64()) for k in ("node", "size", "component", "part", "most")), ("firsts", pa.list_(pa.int32())), ("bits", pa.binary())])
    same = {"part": 0, "bits": J.bitmap(np.arange(100))}
    tests = {True: [], False: []}
    for t in order.tolist():
        rows = [{"node": i, "size": (n := len(sets[i])), "component": i, "most": (9 * (n - h.index(t)) - 4 * n) // 4, "firsts": h[: J.FIRST]} | same for i, h in enumerate(heads) if t in h]
        for bound in tests if len(rows) > 1 else ():
            some = rows if bound else [r | {"most": 10**6} for r in rows]
            batch = pa.RecordBatch.from_arrays([pa.array([some], pa.list_(kind)), pa.array([t]), pa.array([False]), pa.array([0])], names=["m", "token", "two", "block"])
            found = [p for b in J._pairs(iter([batch])) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            met = [n for b in J._meet(iter([batch])) for n in b.column("node").to_pylist()]
            assert sorted(met) == sorted({n for p in found for n in p})
            tests[bound] += found
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 5 * len({*sets[i]} & {*sets[j]}) >= 4 * len({*sets[i]} | {*sets[j]})}
    assert len(want) > 50 and want <= set(tests[True]) <= set(tests[False])
    assert len(tests[True]) < 0.8 * len(tests[False])


def test_a_crowd_that_meets_late_in_its_orders_makes_no_lists(spark, monkeypatch):
    """Texts of one passage that each differ from it by more than similar ones may are no crowd; those that are similar are found."""
    rnd = random.Random(6)
    passage = [f"p{i}" for i in range(150)]
    texts = [edited(rnd, passage, 5) for _ in range(60)]
    texts += [edited(rnd, t.split(), 1) for t in texts[:10]]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], KIND).repartition(4)
    label, counts, of = groups(texts), [], J._lists

    def lists(shared, once):
        out = of(shared, once)
        counts.append((shared.count(), out.count()))
        return out

    monkeypatch.setattr(J, "_lists", lists)
    monkeypatch.setattr(J, "BITS", 0)
    monkeypatch.setattr(J, "CROWD", 16)
    assert sorted(r.doc_id for r in C.near_copies(spark, docs, "").collect()) == [i for i in range(len(texts)) if label[i] == i]
    assert counts[0][1] < counts[0][0]
