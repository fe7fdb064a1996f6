"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size is the number of copies that each of its documents should have; the whole part is
certain, the rest a probability. Pivotal rounding makes these whole: two documents meet, and a random part of the words
that one of them stands for (size times probability) goes to the other until one of the two has probability 0 or 1.
The direction is drawn so that every document keeps its probability, and words are moved, not counts, so a source's
sum stays its target up to the last document that is left.

Rows that agree in source, id and size are one unit: as many of them as their probabilities sum up to are certain, and
what is left over is the unit's probability. So no hash is shared, however often a row repeats.

Documents of more than a ``LARGE``-th of their source are settled first, the largest before the others: each meets all that
are smaller, taken together, as these have one probability. If it gets its copy, what it is given comes from all of them
alike, else what it leaves goes to all of them alike. One that only they can balance in one way goes that way. There are
fewer than ``LARGE`` of them in a source.

The others meet in blocks of about ``BLOCK``, drawn by a hash; each block is folded into decisions and at most one
undecided document. Undecided ones meet in blocks again, a tree with log(documents)/log(BLOCK) levels, down to one a
source, which is rounded to the nearer side. Hot sources are many blocks. Draws are hashes: reruns agree.

All of it is DataFrame functions. Sources are aggregated first: one row each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewise.llm import scratch
from tilewise.operators.blocks import rank_in_groups

#: Documents that meet in a block, on average; weights, the share of all words that is mixed, and copies at most.
BLOCK, WEIGHTS, SHARE, MOST = 128, (3, 1, 2), 1.5, 2.0
#: The part of a source from which on a document is settled first; rows of a unit that are counted out at once.
LARGE, ROWS = 1000, 1 << 16
#: Sources up to which their targets, a row each, are broadcast.
SOURCES = 10_000
_WORD = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"
_UNIT = "struct<size:bigint,h:bigint,id:{id},p:double>"
#: Large documents of a source, the largest first, against all smaller ones of one probability p and m words.
_SETTLE = """
    aggregate(
      large,
      named_struct('m', mass, 'p', p, 'done', cast(array() as array<struct<id:{id},size:bigint,h:bigint,pick:int,p:double>>)),
      (acc, b) -> transform(array(named_struct('m', acc.m - b.size, 'up', (1 - acc.p) * b.size, 'down', acc.p * b.size,
          'u', shiftrightunsigned(xxhash64(b.h, {seed}L), 11) * pow(2D, -53))), t ->
        case when t.m > 0 and t.up <= acc.p * t.m and (t.u < acc.p or t.down > (1 - acc.p) * t.m)
          then named_struct('m', t.m, 'p', greatest(0D, acc.p - t.up / t.m), 'done', array_append(acc.done, named_struct('id', b.id, 'size', b.size, 'h', b.h, 'pick', 1, 'p', 1D)))
        when t.m > 0 and t.down <= (1 - acc.p) * t.m
          then named_struct('m', t.m, 'p', least(1D, acc.p + t.down / t.m), 'done', array_append(acc.done, named_struct('id', b.id, 'size', b.size, 'h', b.h, 'pick', 0, 'p', 0D)))
        else named_struct('m', t.m, 'p', acc.p, 'done', array_append(acc.done, named_struct('id', b.id, 'size', b.size, 'h', b.h, 'pick', cast(null as int), 'p', acc.p)))
        end)[0])
"""
_FOLD = """
    aggregate(
      units,
      named_struct('done', cast(array() as array<struct<id:{id},size:bigint,pick:int>>), 'rest', cast(null as {unit})),
      (acc, b) -> case when acc.rest is null then named_struct('done', acc.done, 'rest', b) else
        transform(array(named_struct(
          'up', (1 - acc.rest.p) * acc.rest.size, 'down', acc.rest.p * acc.rest.size, 'all', (1 - b.p) * b.size, 'none', b.p * b.size,
          'u', shiftrightunsigned(xxhash64(acc.rest.h, b.h, {seed}L), 11) * pow(2D, -53))), t ->
          case when t.u * (least(t.up, t.none) + least(t.down, t.all)) < least(t.down, t.all) then
            case when t.up <= t.none
              then named_struct('done', array_append(acc.done, named_struct('id', acc.rest.id, 'size', acc.rest.size, 'pick', 1)),
                                'rest', named_struct('size', b.size, 'h', b.h, 'id', b.id, 'p', greatest(0D, b.p - t.up / b.size)))
              else named_struct('done', array_append(acc.done, named_struct('id', b.id, 'size', b.size, 'pick', 0)),
                                'rest', named_struct('size', acc.rest.size, 'h', acc.rest.h, 'id', acc.rest.id, 'p', least(1D, acc.rest.p + t.none / acc.rest.size)))
            end
          else
            case when t.down <= t.all
              then named_struct('done', array_append(acc.done, named_struct('id', acc.rest.id, 'size', acc.rest.size, 'pick', 0)),
                                'rest', named_struct('size', b.size, 'h', b.h, 'id', b.id, 'p', least(1D, b.p + t.down / b.size)))
              else named_struct('done', array_append(acc.done, named_struct('id', b.id, 'size', b.size, 'pick', 1)),
                                'rest', named_struct('size', acc.rest.size, 'h', acc.rest.h, 'id', acc.rest.id, 'p', greatest(0D, acc.rest.p - t.all / acc.rest.size)))
            end
          end)[0]
        end)
"""


def words(text: str) -> F.Column:
    """The number of ``[^\\x20\\x09-\\x0D]+`` in a text; null: 0. No word is held; the text becomes a mark for each."""
    c = F.col(text)
    return F.when(c.rlike(r"[^\x20\x09-\x0D]"), F.octet_length(F.regexp_replace(c, _WORD, "."))).otherwise(0).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n, target) of sizes (source, source_size, n).

    Weights go to the sources in the order of their code points, null last, and repeat. Targets share ``share`` of all
    sizes by weight; none is above ``most`` times its source's size, and what is above is shared anew among the others.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1))
    # In the order in which sources reach their limit: the level if all before are at theirs.
    reach = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before, everything = reach.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    budget = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most
    left = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    w = w.withColumn("level", budget / left).withColumn("full", F.col("source_size") * most <= F.col("level") * F.col("w"))
    level = F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("w"), "source", "level"))).over(everything)["level"]
    return w.select("source", "source_size", "n", F.when(F.col("full"), F.col("source_size") * F.lit(float(most))).otherwise(level * F.col("w")).alias("target"))


def _counts(df: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[float], share: float, most: float, seed: int) -> DataFrame:
    """(source, source_size, target, id, size, rows, base, extra): how many rows there are, the copies of each, and how many get one more."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(text_col).alias("size"))
    units = scratch.save(rows.groupBy("id", "source", "size").agg(F.count("*").alias("rows")), "sizes")
    sums = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("n"))
    shares = scratch.save(targets(sums, weights, share, most), "targets")
    keys = ["source", "source_size", "target", "base", "n"]
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    few, named = shares.count() <= SOURCES, shares.withColumnRenamed("source", "s")
    both = units.join(F.broadcast(named) if few else named, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    both = both.withColumn("ratio", F.round(ratio, 12)).withColumn("base", F.floor("ratio").cast("int"))
    both = both.withColumn("sum", F.round((F.col("ratio") - F.col("base")) * F.col("rows"), 9)).withColumn("whole", F.floor("sum")).withColumn("p", F.col("sum") - F.col("whole"))
    fixed = (F.col("size") == 0) | (F.col("p") == 0)
    out = [both.where(fixed).select(*keys, "id", "size", F.lit(0).alias("pick"))]
    open_ = both.where(~fixed).withColumn("h", F.xxhash64(F.col("id"), F.col("size"), F.lit(seed)))
    alone = F.col("rows") == 1  # these have their source's probability
    large = alone & (F.col("size") * LARGE > F.col("source_size"))
    first = F.collect_list(F.when(large, F.struct("size", "h", "id")))  # fewer than LARGE, as they are parts of a sum
    heads = open_.where(alone).groupBy(*keys).agg(F.sum("size").alias("mass"), F.max("p").alias("p"), F.reverse(F.array_sort(first)).alias("large"))
    settled = scratch.save(heads.select(*keys, F.expr(_SETTLE.format(id=kind, seed=seed * 64)).alias("f")).select(*keys, "f.p", "f.done"), "large")
    done = settled.select(*keys, F.explode("done").alias("d"))
    out.append(done.where("d.pick is not null").select(*keys, "d.id", "d.size", "d.pick"))
    now = settled.select(F.col("source").alias("s"), F.col("p").alias("now"))
    small = open_.where(~large).join(F.broadcast(now) if few else now, F.col("source").eqNullSafe(F.col("s")), "left")
    small = small.select(*keys, F.struct("size", "h", "id", F.when(alone, F.col("now")).otherwise(F.col("p")).alias("p")).alias("unit"))
    rest = small.union(done.where("d.pick is null").select(*keys, F.struct("d.size", "d.h", "d.id", "d.p").alias("unit")))
    most_rows = shares.agg(F.max("n")).first()[0] or 0
    blocks, level = F.col("n"), 0
    while True:
        blocks, level, most_rows = F.ceil(blocks / BLOCK), level + 1, -(-most_rows // BLOCK)
        block = F.pmod(F.xxhash64(F.col("unit.h"), F.lit(level)), blocks)
        met = rest.groupBy(*keys, block.alias("block")).agg(F.reverse(F.array_sort(F.collect_list("unit"))).alias("units"))
        fold = F.expr(_FOLD.format(id=kind, unit=_UNIT.format(id=kind), seed=seed * 64 + level))
        folded = scratch.save(met.select(*keys, fold.alias("f")).select(*keys, "f.done", "f.rest"), "folded")
        out.append(folded.select(*keys, F.explode("done").alias("d")).select(*keys, "d.id", "d.size", "d.pick"))
        rest = folded.where("rest is not null").select(*keys, F.col("rest").alias("unit"))
        if most_rows <= 1:
            break
    out.append(rest.select(*keys, "unit.id", "unit.size", (F.col("unit.p") >= 0.5).cast("int").alias("pick")))
    all_ = out[0]
    for x in out[1:]:
        all_ = all_.union(x)
    picks = all_.select(F.col("id").alias("i"), F.col("source").alias("s"), F.col("size").alias("z"), "pick")
    same = F.col("id").eqNullSafe(F.col("i")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
    some = F.when(F.col("size") > 0, F.col("base")).otherwise(0).alias("base")
    extra = F.when(F.col("size") > 0, F.col("whole") + F.col("pick")).otherwise(0).cast("bigint").alias("extra")
    return both.join(picks, same).select("source", "source_size", "target", "id", "size", "rows", some, extra)


def copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 0) -> DataFrame:
    """(id, source, size, source_size, target, copies): how often the mix takes each row of df, whole.

    Null, empty and blank texts have size 0 and no copies. Null is a source of its own, after the others. Repeated rows
    and rows with one id are documents of their own; ids may be null. Texts of any length are counted whole. An empty
    table gives an empty result. Other columns of df are not read.
    """
    counts = _counts(df, id_col, text_col, source_col, weights, share, most, seed)
    part = F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / ROWS)))  # no array has a place for each of many rows
    each = counts.withColumn("part", part).withColumn("at", F.explode(F.sequence(F.col("part") * ROWS + 1, F.least(F.col("rows"), (F.col("part") + 1) * ROWS))))
    n = (F.col("base") + (F.col("at") <= F.col("extra")).cast("int")).alias("copies")
    return each.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", n)


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 0) -> DataFrame:
    """The rows of df that the mix takes, each as often as ``copies`` says, all columns as they are.

    Of rows that agree in id, source and size, those with the least hash of the text are taken once more.
    """
    own = scratch.prefix(df)
    names = ["id", "source", "size", "rows", "base", "extra"]
    counts = scratch.save(_counts(df, id_col, text_col, source_col, weights, share, most, seed).select(*[F.col(c).alias(f"{own}{c}") for c in names]), "counts")
    keyed = df.withColumn(f"{own}z", words(text_col))
    same = F.col(id_col).eqNullSafe(F.col(f"{own}id")) & F.col(source_col).eqNullSafe(F.col(f"{own}source")) & (F.col(f"{own}z") == F.col(f"{own}size"))
    taken = (F.col(f"{own}base") > 0) | (F.col(f"{own}extra") > 0)
    both = keyed.join(counts.where(taken), same)
    several = F.col(f"{own}rows") > 1
    alone, at = both.where(~several).withColumn(f"{own}at", F.lit(0).cast("bigint")), f"{own}at"
    if counts.where(several & taken).isEmpty():
        both = alone
    else:
        ranked = rank_in_groups(both.where(several).withColumn(f"{own}text", F.xxhash64(text_col)), [f"{own}id", f"{own}source", f"{own}size"], [f"{own}text"], at)
        both = alone.unionByName(ranked.drop(f"{own}text"))
    both = both.withColumn(f"{own}n", F.col(f"{own}base") + (F.col(at) < F.col(f"{own}extra")).cast("int")).where(F.col(f"{own}n") > 0)
    return both.withColumn(f"{own}n", F.explode(F.sequence(F.lit(1), F.col(f"{own}n")))).select(*[f"`{c}`" for c in df.columns])


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
