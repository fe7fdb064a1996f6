import hashlib
import random
import re
import sys
import zlib
from functools import cache

import pytest

from tilewise.llm import conversations as C

DIR = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"
sys.setrecursionlimit(20_000)


def plain(rows):
    """(cost, edits) by recursion from the end: rows are (initial, has to go, truncated)."""
    step = {"0s": "s", "0u": "u", "su": "u", "au": "u", "ua": "a"}

    @cache
    def best(i, state, inserted):
        options = [(0, "")] if i == len(rows) and state in "0a" else []
        fits = "a" if state == "u" else "u"
        if inserted < 3:
            c, e = best(i, fits, inserted + 1)
            options.append((c + 2, "I" + e))
        if i < len(rows):
            initial, gone, cut = rows[i]
            c, e = best(i + 1, state, 0)
            options.append((c + 3, "D" + e))
            if not gone:
                c, e = best(i + 1, fits, 0)
                options.append((c + 2 + cut, "R" + e))
                if initial and state + initial in step:
                    c, e = best(i + 1, step[state + initial], 0)
                    options.append((c + cut, "K" + e))
        return min(options, default=(10**9, ""))

    return best(0, "0", 0)


def expected(rows):
    """The whole result of one conversation's rows (turn, role, text), already damaged and without nulls but in turn."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        last = text.rstrip(SPACE)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    cost, edits = plain(tuple((r[1][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(rows, faults)))
    out, left = [], list(rows)
    for e in edits:
        if e == "I":
            out.append(("assistant" if out and out[-1][0][0] == "u" else "user", ""))
            continue
        _, role, text = left.pop(0)
        if e != "D":
            out.append((role if e == "K" else "assistant" if out and out[-1][0][0] == "u" else "user", text))
    turns = [r[0] for r in rows if r[0] is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out))
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": faults.count("blank"), "duplicate": faults.count("duplicate"),
        "truncated": faults.count("truncated"), "illegal": illegal, "cost": cost, "audit": edits, "turns": out,
    }


def damaged(conv, turn, role, text):
    word = lambda x: " " if x is None else str(x)
    which = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
    role, text = word(role), word(text)
    text = "" if which == 1 else re.sub("[.!?]", "", text) if which == 2 else text
    return [] if which == 0 else [(turn, "user" if which == 4 else role, text)] * (1 + (which == 3))


def grouped(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).extend(damaged(conv, turn, role, text))
    return out


def made(seed, convs, longest):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "and so", "", " \t", "Fine.  \n", "Ünïcode。", "x" * 3000 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "unknown"]
    rows = []
    for c in [None, *range(convs)]:
        n = r.randint(0, longest)
        rows += [(c, r.choice([None, t, t, t, t]), r.choice(roles[2:] if r.random() < 0.2 else roles[:2]), r.choice([*texts, None] if r.random() < 0.5 else [f"{t}."])) for t in range(n)]
    return rows


@pytest.mark.parametrize("seed", range(40))
def test_walk_is_cheapest_and_least(seed):
    r = random.Random(seed)
    rows = [(r.choice("uaus"[: 2 + r.randint(0, 2)] + "x"), r.random() < 0.2, r.random() < 0.2) for _ in range(r.randint(0, 14))]
    rows = [(i, g, t and not g) for i, g, t in rows]
    want = plain(tuple(rows))
    assert C.audit(rows) == want
    for block in (1, 2, 3, 5):
        assert C.audit(rows, block) == want


def test_long_conversation_in_blocks():
    r = random.Random(5)
    rows = [(r.choice("uua"), r.random() < 0.1, False) for _ in range(700)]
    cost, edits = C.audit(rows, 100)
    whole = next(iter(C.walk(rows, C.START, C.ENDS).values()))
    assert (cost, edits) == whole


@pytest.mark.parametrize("fragment", [C.FRAGMENT, 3])
def test_equals_brute_force(spark, fragment):
    rows = made(1, 60, 12) + [(1000, t, "user" if t % 3 else "assistant", f"turn {t % 400}" + "." * (t % 5 > 0)) for t in range(600)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {x.conv: x for x in C.repair(C.damage(df), exists_col="there", fragment=fragment).collect()}
    want = grouped(rows)
    assert set(got) == set(want)
    for conv, turns in want.items():
        e = expected(turns)
        assert [tuple(t) for t in got[conv].repaired] == e.pop("turns")
        assert {k: got[conv][k] for k in e} == e


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: r for r in C.op13_conversation_repair(spark, DIR).collect()}
    want = grouped(rows)
    assert set(got) == set(want)
    for conv, turns in want.items():
        e = expected(turns)
        text = "\n".join(f"{r}:{t}" for r, t in e.pop("turns"))
        assert got[conv].repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert {k: got[conv][k] for k in e} == e


def test_odd_tables(spark):
    kind = "conv_id long, turn long, role string, text string, conv string, key int"
    assert C.repair(spark.createDataFrame([], kind)).collect() == []
    rows = [(1, 0, "user", "Hi.", "a", 1), (1, 1, "assistant", "Yes.", "b", 2), (2, None, None, None, None, None), (None, 5, "user", "x" * 200_000 + ".", "c", 3)]
    got = {r.conv: r for r in C.repair(spark.createDataFrame(rows, kind)).collect()}
    assert (got[1].audit, got[1].cost) == ("KK", 0) and [tuple(t) for t in got[1].repaired] == [("user", "Hi."), ("assistant", "Yes.")]
    assert (got[2].audit, got[2].blank, got[2].gaps) == ("D", 1, 0) and got[2].repaired == []
    assert (got[None].audit, got[None].cost) == ("KI", 2) and got[None].repaired[0].text == "x" * 200_000 + "."
    gone = spark.createDataFrame([(7, 1, "user", "Hi.", False)], "conv_id long, turn long, role string, text string, there boolean")
    row = C.repair(gone, exists_col="there", sink=C.Digest).first()
    assert (row.conv, row.audit, row.cost, row.gaps) == (7, "", 0, 0) and row.repaired == hashlib.sha256(b"").hexdigest()
