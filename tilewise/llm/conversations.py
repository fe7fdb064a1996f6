"""Conversation structure repair: the cheapest edits that make the roles of a conversation alternate.

A conversation's roles should read ``(s?(ua)+)?`` by their initials. Edits on its rows, in order: keep one (K, free), give
it the role that fits (R, 2), delete it (D, 3), insert an empty turn (I, 2); blank and duplicate rows have to go, and a
truncated row that stays costs 1. The lattice has a node for each number of rows done and state of the grammar. A* walks
it with the suffix sums of what no edit can avoid (3 for a row that has to go, 1 for a truncated one), which is
consistent, so a node is final when it leaves the queue. The queue is keyed by (cost so far + heuristic, audit): of equally
cheap ways the one whose edits spell the least string comes first.

Rows are sorted by range over all conversations. Of each range, conversations that lie wholly inside are finished in the
task that reads them, one after the other. Those that touch an end of a range, at most two of each and any conversation
too large for one, go on as fragments of ``FRAGMENT`` rows: a fragment's effect is a table from entry state to exit
state, tables are folded in order, and the repaired turns flow in order into a sink. So no task holds the texts of a
conversation that is larger than its range.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
from collections.abc import Callable, Iterable

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from tilewise.llm import scratch

#: Rows that A* walks at once; rows and bytes of text of a fragment.
BLOCK, FRAGMENT, FRAGMENT_BYTES = 256, 1024, 1 << 22
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
#: States of the grammar: nothing yet, after s, after u, after a. Which state an initial leads to.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STEP = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_A, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A}
ENDS = (START, AFTER_A)
LEGAL = ("su", "ua", "au")
_SPACE = " \t\n\x0b\x0c\r"

#: A row as the walk sees it: its role's initial, whether it has to go, whether it is truncated.
Row = tuple[str, bool, bool]


def walk(rows: list[Row], entry: int, ends: tuple[int, ...] | None = None) -> dict[int, tuple[int, str]]:
    """{exit state: (cost, audit)} of the cheapest ways through rows from a state; with ends, only the first of these that is reached."""
    n = len(rows)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + (DELETE if rows[i][1] else TRUNCATED if rows[i][2] else 0)
    queue, closed, found = [(rest[0], "", 0, entry)], set(), {}
    while queue:
        f, audit, i, state = heapq.heappop(queue)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        cost = f - rest[i]
        if i == n:
            found[state] = (cost, audit)
            if ends and state in ends:
                return {state: found[state]}
        fits = AFTER_A if state == AFTER_U else AFTER_U
        heapq.heappush(queue, (f + INSERT, audit + "I", i, fits))
        if i < n:
            initial, gone, cut = rows[i]
            heapq.heappush(queue, (cost + DELETE + rest[i + 1], audit + "D", i + 1, state))
            if not gone:
                stays = cost + TRUNCATED * cut + rest[i + 1]
                heapq.heappush(queue, (stays + REROLE, audit + "R", i + 1, fits))
                if (state, initial) in STEP:
                    heapq.heappush(queue, (stays, audit + "K", i + 1, STEP[state, initial]))
    return found


def fold(ways: dict[int, tuple[int, tuple[str, ...]]], table: dict[int, dict[int, tuple[int, str]]]) -> dict[int, tuple[int, tuple[str, ...]]]:
    """Ways up to a block, and the block's table, as ways up to its end; an audit is kept as its parts."""
    out: dict[int, tuple[int, tuple[str, ...]]] = {}
    for state, (cost, parts) in ways.items():
        for end, (more, audit) in table[state].items():
            have = out.get(end)
            if have is None or cost + more < have[0] or cost + more == have[0] and "".join((*parts, audit)) < "".join(have[1]):
                out[end] = (cost + more, (*parts, audit))
    return out


def tables(rows: list[Row], block: int = BLOCK) -> Iterable[dict[int, dict[int, tuple[int, str]]]]:
    """The table of each block of rows."""
    for at in range(0, len(rows), block):
        yield {entry: walk(rows[at : at + block], entry) for entry in range(4)}


def cheapest(ways: dict[int, tuple[int, tuple[str, ...]]]) -> tuple[int, tuple[str, ...]]:
    """Of the ways that end a conversation, the cheapest, and of these the one that spells the least string."""
    return min((ways[s] for s in ENDS if s in ways), key=lambda w: (w[0], "".join(w[1])))


def audit(rows: list[Row], block: int = BLOCK) -> tuple[int, str]:
    """(cost, edits) of the cheapest repair of a conversation; no rows: nothing to do."""
    if len(rows) <= block:
        return next(iter(walk(rows, START, ENDS).values()))
    ways = {START: (0, ())}
    for t in tables(rows, block):
        ways = fold(ways, t)
    cost, parts = cheapest(ways)
    return cost, "".join(parts)


def turns(edits: str, rows: Iterable[tuple[str, str]], state: int = START) -> Iterable[tuple[str, str]]:
    """(role, text) of the repaired turns that edits make of rows (role, text)."""
    given = iter(rows)
    for e in edits:
        fits, role = (AFTER_A, "assistant") if state == AFTER_U else (AFTER_U, "user")
        if e == "I":
            yield role, ""
            state = fits
            continue
        have, text = next(given)
        if e == "R":
            yield role, text
            state = fits
        elif e == "K":
            yield have, text
            state = STEP[state, have[:1]]


class Turns:
    """A sink that keeps the repaired turns."""

    schema = "array<struct<role:string,text:string>>"

    def __init__(self):
        self.value: list = []

    def add(self, role: str, text: str) -> None:
        self.value.append({"role": role, "text": text})


class Digest:
    """A sink that keeps the SHA-256 of ``role:text`` of the turns, joined by newlines."""

    schema = "string"

    def __init__(self):
        self._sha, self._any = hashlib.sha256(), False

    def add(self, role: str, text: str) -> None:
        self._sha.update((("\n" if self._any else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self._any = True

    @property
    def value(self) -> str:
        return self._sha.hexdigest()


class _Facts:
    """Counts over the rows of a conversation, in order; rows are (turn, role, text, dropped)."""

    def __init__(self):
        self.low = self.high = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.last = ""
        self.seen = False

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.distinct += turn != self.high
            self.high = turn
        self.illegal += self.seen and self.last + initial not in LEGAL
        self.last, self.seen = initial, True
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)

    def row(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal}


def _fault(text: str, again: bool) -> str:
    """A row's first fault; again: whether its role and text were there before."""
    end = text.rstrip(_SPACE)
    return "blank" if not end else "duplicate" if again else "truncated" if end[-1] not in ".!?" else ""


def _key(role: str, text: str) -> bytes:
    raw = role.encode("utf-8", "surrogatepass")
    return hashlib.blake2b(len(raw).to_bytes(8, "little") + raw + text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _faults(rows: list[tuple], later: set[int] = frozenset()) -> list[str]:
    """The fault of each row; later: rows that repeat one of an earlier fragment."""
    keys, out = set(), []
    for i, (_, role, text) in enumerate(rows):
        k = _key(role, text)
        out.append(_fault(text, k in keys or i in later))
        keys.add(k)
    return out


def _walkable(rows: list[tuple], faults: list[str]) -> list[Row]:
    return [(role[:1], fault in ("blank", "duplicate"), fault == "truncated") for (_, role, _), fault in zip(rows, faults)]


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _batch(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", exists_col: str | None = None, sink: Callable = Turns, fragment: int = FRAGMENT) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired): a row for each conversation.

    Rows are taken by turn, nulls first; rows of one turn by role and text, so equal rows are neighbours. A null role or text
    is one space. Null is a conversation like any other. Each row's first fault counts: blank, duplicate (role and text
    were there before), truncated (no ``.!?`` at its end). illegal counts neighbours whose initials aren't su, ua or au;
    gaps are the turns that are missing between the first and the last one, null turns aside. ``repaired`` is what the sink
    makes of the repaired turns: a list of them, or a digest. Rows whose exists_col isn't true only say that there is such
    a conversation: one without others has zeros, no edits and an empty sink. Texts are whole, however long. An empty
    table has no rows. Other columns aren't read.
    """
    spark = df.sparkSession
    there = F.coalesce(F.col(exists_col), F.lit(False)) if exists_col else F.lit(True)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"), there.alias("there"))
    rows = rows.withColumn("begin", F.substring("text", 1, 64))  # orders as the text does; range bounds stay small
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "conv", "turn", "role", "begin").sortWithinPartitions("conv", "turn", "role", "text").drop("begin")

    kind = rows.schema["conv"].dataType
    result = StructType([StructField("conv", kind), *_parse_datatype_string(RESULT).fields, StructField("repaired", _parse_datatype_string(sink.schema))])
    from pyspark.sql.pandas.types import to_arrow_schema

    names = result.names
    whole = StructType([*result.fields, StructField("key", _parse_datatype_string("string")), StructField("part", _parse_datatype_string("int")), StructField("seq", _parse_datatype_string("int")), StructField("rows", _parse_datatype_string("binary"))])
    arrow = to_arrow_schema(whole)

    def one(conv, held: list[tuple]) -> dict:
        faults, facts, into = _faults(held), _Facts(), sink()
        for (turn, role, _), fault in zip(held, faults):
            facts.add(turn, role[:1], fault)
        cost, edits = audit(_walkable(held, faults))
        for role, text in turns(edits, ((r, t) for _, r, t in held)):
            into.add(role, text)
        return {"conv": conv, **facts.row(), "cost": cost, "audit": edits, "repaired": into.value}

    def piece(conv, part: int, seq: int, held: list[tuple]) -> dict:
        return {"conv": conv, "key": "null" if conv is None else f"v{conv}", "part": part, "seq": seq, "rows": zstandard.compress(pickle.dumps(held))}

    def task(batches):
        part, first, now, started = TaskContext.get().partitionId(), True, None, False
        held: list[tuple] = []
        size = seq = 0
        out: list[dict] = []

        def close(last: bool):
            """The conversation that ends: finished, unless it may have rows in another range."""
            nonlocal held, size, seq, first
            if first or last or seq:
                out.append(piece(now, part, seq, held))
            else:
                out.append(one(now, held))
            first, held, size, seq = False, [], 0, 0

        for batch in batches:
            for conv, turn, role, text, there in zip(*(c.to_pylist() for c in batch.columns)):
                if started and conv != now:
                    close(False)
                now, started = conv, True
                if there:
                    if len(held) >= fragment or size > FRAGMENT_BYTES:
                        out.append(piece(now, part, seq, held))
                        held, size, seq = [], 0, seq + 1
                    held.append((turn, role, text))
                    size += len(text)
                if len(out) >= 256:
                    yield _batch(arrow, out)
                    out.clear()
        if started:
            close(True)
        if out:
            yield _batch(arrow, out)

    done = scratch.save(rows.mapInArrow(task, whole), "repaired")
    return done.where("rows is null").select(names).union(_chained(done.where("rows is not null").select("conv", "key", "part", "seq", "rows"), sink, result))


def _chained(frags: DataFrame, sink: Callable, result: StructType) -> DataFrame:
    """Results of conversations in fragments (conv, key, part, seq, rows); their order is that of part and seq."""
    from pyspark.sql.pandas.types import to_arrow_schema

    at = ["key", "part", "seq"]

    def keys(batches):
        for b in batches:
            for key, part, seq, blob in zip(*(b.column(c).to_pylist() for c in (*at, "rows"))):
                found: dict[bytes, int] = {}
                for i, (_, role, text) in enumerate(pickle.loads(zstandard.decompress(blob))):
                    found.setdefault(_key(role, text), i)
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * n, pa.string()), pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int32())],
                    names=[*at, "k", "i"],
                )

    # A text that an earlier fragment has is a duplicate from its first place on; those after it repeat that one.
    seen = frags.select(*at, "rows").mapInArrow(keys, "key string, part int, seq int, k binary, i int")
    first = seen.groupBy("key", "k").agg(F.min(F.struct("part", "seq")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = seen.join(first, ["key", "k"]).where(F.struct("part", "seq") > F.col("first")).groupBy(*at).agg(F.collect_list("i").alias("later"))
    known = scratch.save(frags.join(later, at, "left"), "fragments")

    def judge(batches):
        for b in batches:
            for key, part, seq, blob, again in zip(*(b.column(c).to_pylist() for c in (*at, "rows", "later"))):
                held = pickle.loads(zstandard.decompress(blob))
                ways = {e: {e: (0, ())} for e in range(4)}
                for t in tables(_walkable(held, _faults(held, set(again or ())))):
                    ways = {e: fold(w, t) for e, w in ways.items()}
                table = {e: {x: (c, "".join(p)) for x, (c, p) in w.items()} for e, w in ways.items()}
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([zstandard.compress(pickle.dumps(table))], pa.binary())], names=[*at, "table"])

    def decide(batches):
        """In order: the edits of each fragment of the conversations."""

        def end():
            for (part, seq), edits in zip(places, cheapest(ways)[1]):
                yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([edits], pa.string())], names=[*at, "edits"])

        now, ways, places = None, {}, []
        for b in batches:
            for key, part, seq, blob in zip(*(b.column(c).to_pylist() for c in (*at, "table"))):
                if key != now:
                    if now is not None:
                        yield from end()
                    now, ways, places = key, {START: (0, ())}, []
                ways = fold(ways, pickle.loads(zstandard.decompress(blob)))
                places.append((part, seq))
        if now is not None:
            yield from end()

    def follow(batches):
        """In order: the rows of a conversation into its counts and its sink."""

        def end():
            return _batch(schema, [{"conv": conv, **facts.row(), "cost": cost, "audit": "".join(edits), "repaired": into.value}])

        now = conv = facts = into = None
        state = cost = 0
        edits: list[str] = []
        for b in batches:
            for key, given, blob, again, more in zip(*(b.column(c).to_pylist() for c in ("key", "conv", "rows", "later", "edits"))):
                if key != now:
                    if now is not None:
                        yield end()
                    now, conv, facts, into, state, cost, edits = key, given, _Facts(), sink(), START, 0, []
                held = pickle.loads(zstandard.decompress(blob))
                faults = _faults(held, set(again or ()))
                for (turn, role, _), fault in zip(held, faults):
                    facts.add(turn, role[:1], fault)
                for role, text in turns(more, ((r, t) for _, r, t in held), state):
                    into.add(role, text)
                    state = STEP[state, role[:1]]
                kept = [f for e, f in zip((e for e in more if e != "I"), faults) if e != "D"]
                cost += DELETE * more.count("D") + REROLE * more.count("R") + INSERT * more.count("I") + TRUNCATED * kept.count("truncated")
                edits.append(more)
        if now is not None:
            yield end()

    schema = to_arrow_schema(result)
    judged = known.select(*at, "rows", "later").mapInArrow(judge, "key string, part int, seq int, table binary")
    decided = judged.repartition("key").sortWithinPartitions(*at).mapInArrow(decide, "key string, part int, seq int, edits string")
    both = known.join(decided, at).repartition("key").sortWithinPartitions(*at)
    return both.select("key", "conv", "rows", "later", "edits").mapInArrow(follow, result)


def damage(df: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) with faults, by CRC-32 of ``conv_id:turn`` modulo 20, and ``there``.

    0 drops a row (it stays with there = false), 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes it the
    user's. Nulls are one space.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    which = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = df.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), which.alias("which"))
    said = F.when(F.col("which") == 1, F.lit("")).when(F.col("which") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("which") == 4, F.lit("user")).otherwise(F.col("role"))
    often = F.explode(F.when(F.col("which") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), said.alias("text"), (F.col("which") != 0).alias("there"), often.alias("copy")).drop("copy")


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """The repair of every conversation after damage."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    fixed = repair(damage(rows), exists_col="there", sink=Digest)
    return fixed.withColumnsRenamed({"conv": "conv_id", "repaired": "repaired_sha256"})
