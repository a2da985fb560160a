"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Targets: the sources share ``total`` words by weight; a target stops at ``max_passes`` times its
   source, and the excess is shared again by weight. The limit of that is a common level: a source
   gets the lesser of its cap and level x weight, so sorted prefix sums give it in one pass.
2. Blocks: documents fall into blocks of about ``block_docs`` by a hash of their id, so that a block
   is a random part of its source and blocks in number order are a random permutation. A source is
   taken whole as often as its target allows; one more pass takes blocks in order up to the target,
   of the block that crosses it the documents that still fit, longest first, and so on with the room
   left in the blocks after it.
3. Tree: the exact number of draws (block and pass) of each source is split recursively between two
   halves of the output shards. A split gives the left half of each source in turn as many as a
   hypergeometric draw from the units left says, which together is a multivariate hypergeometric draw;
   quotas stay exact at every level.
4. Every leaf takes its quota as the next disjoint draws of the source's permutation; rows go to
   their shard and are shuffled there by a hash.

Only DataFrame functions; all randomness is a hash of the seed, so reruns agree. Per-document tables
are joined on (source, block); only per-source and per-node rows meet in one task. The sources'
quotas of a tree node are one row: their number, not their size, must fit in memory.

Defined results: a null text has size 0; a null source is a source, the last; a null id is an id like
others; repeated rows are taken equally often (in the crossing block they fit together or not at
all); sizes and targets of empty sources are 0; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE_CLASS, fresh, stored

SEED = 20240229
BLOCK_DOCS = 256
MAX_PASSES = 3


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE_CLASS}]+")).cast("long")


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "sizes")


def cyclic_weights(rank: Column) -> Column:
    """1, 2, 3, repeating."""
    return (F.pmod(rank - 1, F.lit(3)) + 1).cast("double")


def source_targets(rows: DataFrame, weight=cyclic_weights, max_passes: int = MAX_PASSES, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Per source: sid (its place in code-point order, null last), source_size, target, full passes, words of the last pass, blocks."""
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    per = per.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    per = per.withColumn("weight", weight(F.col("sid"))).withColumn("cap", F.col("source_size").cast("double") * max_passes)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    per = per.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    target = F.least(F.col("cap"), F.col("level") * F.col("weight"))
    per = per.withColumn("target", F.greatest(target, F.lit(0.0)))
    full = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_passes))).otherwise(0)
    per = per.withColumn("full", full.cast("int"))
    per = per.withColumn("rest", F.floor(F.col("target") - F.col("full") * F.col("source_size") + 1e-6).cast("long"))
    blocks = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("n_docs") / block_docs, F.lit(1.0))))).cast("long")
    return per.select("sid", "source", "source_size", "target", "full", "rest", blocks.alias("blocks"))


def _key(id_column) -> Column:
    """An id that is never null, so that membership in a list of ids is never unknown."""
    return F.coalesce((F.col(id_column) if isinstance(id_column, str) else id_column).cast("bigint"), F.lit(-(2**63)))


def _in_blocks(rows: DataFrame, sources: DataFrame) -> DataFrame:
    block = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.col("blocks"))
    return rows.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("block", block)


def _longest_first(units: DataFrame) -> DataFrame:
    """Per (sid, block) of ``units`` (sid, block, room, doc_id, size): the keys that fit the room, longest first, and the room left."""
    longest_first = F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("neg"), F.xxhash64(F.lit(SEED + 1), "doc_id").alias("mix"), _key("doc_id").alias("id"))))
    start = F.struct(F.col("room").alias("left"), F.array().cast("array<bigint>").alias("ids"))
    step = lambda acc, x: F.when(
        (x["neg"] < 0) & (acc["left"] + x["neg"] >= 0),
        F.struct((acc["left"] + x["neg"]).alias("left"), F.array_append(acc["ids"], x["id"]).alias("ids")),
    ).otherwise(acc)
    filled = units.groupBy("sid", "block", "room").agg(longest_first.alias("docs")).select("sid", "block", F.aggregate("docs", start, step).alias("got"))
    return filled.select("sid", "block", F.col("got.ids").alias("fitting"), F.col("got.left").alias("left"))


def _units(placed: DataFrame) -> DataFrame:
    """Rows of an id are one unit: they fit together or not at all."""
    return placed.groupBy("sid", "block", "doc_id").agg(F.sum("size").alias("size"))


def _carried(placed: DataFrame, first: DataFrame) -> DataFrame:
    """Per (sid, block): the ids that the room left after the crossing blocks ``first`` (sid, block, fitting, left) takes of later blocks, in order.

    Only units no longer than the room count. Blocks that these fill are taken in order, and the next block that
    crosses is filled longest first. What is left is then less than half the room, so the rounds are few.
    """
    rooms = stored(first.where("left > 0").select("sid", F.col("block").alias("after"), "left"), "rooms")
    later = lambda rows: rows.join(rooms, "sid").where((F.col("block") > F.col("after")) & (F.col("size") > 0) & (F.col("size") <= F.col("left")))
    # A unit is no shorter than its shortest row with words: blocks without a short row are passed over.
    near = later(placed.select("sid", "block", "size")).select("sid", "block").distinct()
    units = stored(_units(placed.join(near, ["sid", "block"], "left_semi")), "later")
    found = first.select("sid", "block", "fitting")
    in_order = Window.partitionBy("sid").orderBy("block")
    while True:
        units = stored(later(units).select("sid", "block", "doc_id", "size"), "later")
        if units.isEmpty():
            return found
        per = units.groupBy("sid", "block").agg(F.sum("size").alias("words")).join(rooms, "sid")
        per = per.withColumn("room", F.col("left") - F.sum("words").over(in_order) + F.col("words"))
        per = stored(per.where("room > 0").select("sid", "block", "words", "room"), "round")
        filled = stored(_longest_first(units.join(per.select("sid", "block", "room"), ["sid", "block"])), "filled")
        found = found.unionByName(filled.select("sid", "block", "fitting"))
        # Only the last block of a source can have crossed; the others were taken whole.
        last = per.groupBy("sid").agg(F.max("block").alias("block"))
        rooms = stored(filled.join(last, ["sid", "block"]).where("left > 0").select("sid", F.col("block").alias("after"), "left"), "rooms")


def block_plan(placed: DataFrame) -> DataFrame:
    """Per (sid, block): passes, the ids that one more pass takes of the crossing block and of those after it, and the block's place in its source."""
    per = placed.groupBy("sid", "block").agg(F.sum("size").alias("words"), *(F.first(c).alias(c) for c in ("full", "rest")))
    in_order = Window.partitionBy("sid").orderBy("block")
    per = per.withColumns({"place": F.row_number().over(in_order), "until": F.sum("words").over(in_order), "in_source": F.count(F.lit(1)).over(Window.partitionBy("sid"))})
    per = stored(per.withColumn("room", F.col("rest") - (F.col("until") - F.col("words"))), "per_block")
    crossing = (F.col("words") > F.col("room")) & (F.col("room") > 0)
    edge = per.where(crossing).select("sid", "block", "room")
    first = stored(_longest_first(_units(placed.join(edge.select("sid", "block"), ["sid", "block"], "left_semi")).join(edge, ["sid", "block"])), "crossing")
    fits = _carried(placed, first)
    none = F.array().cast("array<bigint>")
    passes = F.col("full") + F.when((F.col("words") <= F.col("room")) & (F.col("room") > 0), 1).otherwise(0)
    out = per.join(fits, ["sid", "block"], "left").withColumns({"passes": passes, "fitting": F.coalesce("fitting", none)})
    out = out.withColumn("draws", F.col("passes") + F.when(F.size("fitting") > 0, 1).otherwise(0))
    # The last pass may miss blocks; its draws are numbered without gaps.
    return out.withColumn("last_place", F.sum((F.col("draws") > F.col("full")).cast("long")).over(in_order))


def split_quotas(quotas: DataFrame, levels: int) -> DataFrame:
    """(sid, quota) -> (shard, sid, quota) for 2 ** levels shards, by recursive multivariate hypergeometric halving."""
    item = "array<struct<sid:int,q:bigint>>"
    node = quotas.agg(F.sort_array(F.collect_list(F.struct(F.col("sid").cast("int").alias("sid"), F.col("quota").cast("long").alias("q")))).alias("left"))
    node = node.select(F.lit(0).cast("long").alias("node"), F.coalesce(F.col("left"), F.array().cast(item)).alias("quotas"))
    for level in range(levels):
        node = node.withColumn("n", F.aggregate("quotas", F.lit(0).cast("long"), lambda a, x: a + x["q"]))
        node = node.withColumn(
            "split",
            F.expr(f"""
              aggregate(quotas, named_struct('room', n div 2, 'units', n, 'taken', cast(array() as {item})), (a, x) ->
                aggregate(array({_hypergeometric(level)}), a, (c, k) -> named_struct(
                  'room', c.room - k, 'units', c.units - x.q, 'taken', array_append(c.taken, named_struct('sid', x.sid, 'q', k)))))"""),
        )
        left = F.col("split.taken")
        right = F.zip_with("quotas", left, lambda x, y: F.struct(x["sid"].alias("sid"), (x["q"] - y["q"]).alias("q")))
        halves = F.array(F.struct((F.col("node") * 2).alias("node"), left.cast(item).alias("quotas")), F.struct((F.col("node") * 2 + 1).alias("node"), right.cast(item).alias("quotas")))
        node = node.select(F.inline(halves))
        if level % 5 == 4:
            node = node.repartition("node")
    return node.select(F.col("node").alias("shard"), F.inline("quotas")).withColumnRenamed("q", "quota").where("quota > 0")


def _hypergeometric(level: int) -> str:
    """How many of ``a.room`` draws without replacement from ``a.units`` units fall on the ``x.q`` units of a source, as SQL.

    Inversion: the chances of the counts within 9 standard deviations and 12 of the most likely one follow from their ratios,
    so the work grows with the root of the quota, and what is left out is below the precision of a double.
    """
    # One-element arrays name what is used more than once.
    least, most = "greatest(0L, a.room - (a.units - x.q))", "least(x.q, a.room)"
    likely = "cast(floor((x.q + 1D) * (a.room + 1D) / (a.units + 2D)) as bigint)"
    spread = "sqrt(1D * a.room * x.q / greatest(a.units, 1L) * (1D - 1D * x.q / greatest(a.units, 1L)) * (a.units - a.room) / greatest(a.units - 1L, 1L))"
    reach = f"cast(ceil(9D * {spread}) as bigint) + 12L"
    ratio = "(x.q - i) * 1D * (a.room - i) / ((i + 1D) * (a.units - x.q - a.room + i + 1D))"
    draw = f"pmod(xxhash64({SEED}, {level}, node, x.sid), 9007199254740992L) / 9007199254740992D"
    steps = "if(z.high > z.low, sequence(z.low, z.high - 1L), cast(array() as array<bigint>))"
    total = f"aggregate({steps}, named_struct('w', 1D, 'sum', 1D), (b, i) -> named_struct('w', b.w * {ratio}, 'sum', b.sum + b.w * {ratio}), b -> b.sum)"
    chosen = f"""aggregate({steps}, named_struct('w', 1D, 'sum', 1D, 'k', z.low), (b, i) -> named_struct(
      'w', b.w * {ratio}, 'sum', b.sum + b.w * {ratio}, 'k', if(b.sum < y, i + 1L, b.k)), b -> b.k)"""
    return f"""transform(array(named_struct('low', greatest({least}, {likely} - ({reach})), 'high', least({most}, {likely} + ({reach})))),
      z -> transform(array({draw} * {total}), y -> {chosen})[0])[0]"""


def mixing_plan(rows: DataFrame, shards: int | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(placed rows, plan per block): the plan lists the shard of each of a block's draws, in order of passes."""
    spark = rows.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = _in_blocks(rows, stored(source_targets(rows, **options), "sources"))
    plan = stored(block_plan(placed), "blocks")
    quotas = plan.groupBy("sid").agg(F.sum("draws").alias("quota"))
    leaves = stored(split_quotas(quotas, max(0, math.ceil(math.log2(max(shards, 1))))), "leaves")
    before = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("quota").over(before), F.lit(0)) + 1
    slots = leaves.withColumn("first", first).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard").select("sid", "shard", F.explode(F.sequence("first", F.col("first") + F.col("quota") - 1)).alias("draw"))
    draws = plan.where("draws > 0").select("sid", "block", F.posexplode(F.sequence(F.lit(0), F.col("draws") - 1)).alias("p", "turn"), "place", "last_place", "full", "in_source")
    place = F.when(F.col("turn") < F.col("full"), F.col("place")).otherwise(F.col("last_place"))
    draws = draws.select("sid", "block", "turn", (F.col("turn") * F.col("in_source") + place).alias("draw"))
    where = draws.join(slots, ["sid", "draw"]).groupBy("sid", "block").agg(F.sort_array(F.collect_list(F.struct("turn", "shard")))["shard"].alias("shards"))
    return placed, plan.select("sid", "block", "passes", "fitting").join(where, ["sid", "block"], "left")


def _repeats() -> Column:
    return F.col("passes") + F.array_contains("fitting", _key("doc_id")).cast("int")


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken (repeats x size), repeats, shards (of its repeats)."""
    placed, plan = mixing_plan(sizes(docs, id_col, text_col, source_col), **options)
    out = placed.join(plan, ["sid", "block"]).withColumn("repeats", _repeats().cast("int"))
    shards = F.slice(F.coalesce("shards", F.array().cast("array<bigint>")), F.lit(1), F.col("repeats"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("repeats") * F.col("size")).alias("taken"), "repeats", shards.alias("shards"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed documents: a row for each repeat, in shards, shuffled within each; all columns of ``docs`` stay."""
    columns = docs.columns
    placed, plan = mixing_plan(sizes(docs, id_col, text_col, source_col), **options)
    key, source, shards, shard, copy = (fresh(columns, f"_mix_{c}") for c in ("id", "source", "shards", "shard", "copy"))
    # Which shards take a row is settled on narrow rows, so texts move twice only: to their plan by id, and to their
    # shard. They never move by source, which may be hot.
    taken = placed.join(plan, ["sid", "block"]).withColumn("repeats", _repeats().cast("int")).where("repeats > 0")
    taken = taken.select(F.col("doc_id").alias(key), F.col("source").alias(source), F.slice("shards", F.lit(1), F.col("repeats")).alias(shards)).dropDuplicates([key, source])
    out = docs.join(taken, docs[id_col].eqNullSafe(F.col(key)) & docs[source_col].eqNullSafe(F.col(source)))
    out = out.select(*columns, F.posexplode(shards).alias(copy, shard))
    order = F.xxhash64(F.lit(SEED + 2), F.col(shard), F.col(id_col), F.col(copy))
    return out.repartition(shard).sortWithinPartitions(shard, order).select(*columns)
