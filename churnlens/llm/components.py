"""Connected components of links by contraction: vertices merge into neighbours, and merged links disappear."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) -> (id, component): for every id that has a link, the smallest id it reaches.

    In each round a vertex points to the neighbour (or itself) that comes first in an order drawn
    anew by hash, and merges into what that one points to. Links whose ends have met are dropped and
    equal links become one, so a round handles a fraction of the links of the round before. The
    pointers of all rounds are followed back at the end. Every round is written to the shared
    folder, so lineage does not grow.
    """
    tidy = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    edges = stored(links.where("a != b").select(*tidy("a", "b")).distinct(), "edges")
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        order = lambda c: F.struct(F.xxhash64(F.lit(len(levels)), c).alias("turn"), F.col(c).alias("id"))  # noqa: B023, E731
        ends = edges.select(F.inline(F.array(F.struct(F.col("a").alias("id"), order("b").alias("other")), F.struct(F.col("b").alias("id"), order("a").alias("other")))))
        # One row per vertex leaves a task that reads links: the first of its neighbours so far.
        first = ends.groupBy("id").agg(F.min("other").alias("other")).select("id", F.least("other", order("id"))["id"].alias("to"))
        onward = first.select(F.col("id").alias("to"), F.col("to").alias("into"))
        merged = stored(first.join(onward, "to").select("id", "into"), "merged")
        levels.append(merged)
        named = lambda c: merged.select(F.col("id").alias(c), F.col("into").alias(f"{c}_into"))  # noqa: B023, E731
        met = edges.join(named("a"), "a").join(named("b"), "b").where("a_into != b_into")
        edges = stored(met.select(*tidy("a_into", "b_into")).distinct(), "edges")
    if not levels:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    found = levels[-1].withColumnRenamed("into", "root")
    for level in reversed(levels[:-1]):
        # A vertex that no link of the next round has is the root of a whole component.
        later = found.select(F.col("id").alias("into"), "root")
        found = level.join(later, "into", "left").select("id", F.coalesce("root", "into").alias("root"))
    found = stored(found, "roots")
    least = found.groupBy("root").agg(F.min("id").alias("component"))
    return stored(found.join(least, "root").select("id", "component"), "components")
