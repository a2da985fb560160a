"""Following renames: a touch takes the name its file has today.

The log is walked newest first. A rename ``old => new`` at line ``pos`` says that older lines (greater
``pos``) that name ``old`` mean ``new``, unless a rename nearer to them says otherwise. So a name is
looked up among the renames before its line, the nearest one wins, and its target is followed from
there; arriving at a name met before ends the chase there.

Names that renames link, directly or over others, form a family, and families say nothing about each other. So the log
is walked family by family, each in order, by as many tasks as there are partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..plans.storage import ship, written


def families(links: DataFrame) -> DataFrame:
    """(_name, _family) of ``links`` (a, b), both longs: the least name of a connected group, by alternating large and small stars."""

    def star(edges: DataFrame, keep) -> DataFrame:
        least = F.least(F.min("b").over(Window.partitionBy("a")), F.col("a"))
        return edges.withColumn("least", least).where(keep)

    edges, before = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"), None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("_name"), F.col("b").alias("_family")).unionByName(edges.select(F.col("b").alias("_name"), F.col("b").alias("_family")).distinct())
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = star(both, "b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))  # what is greater than a goes to the least
        small = star(large, "true").select(F.explode(F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("e"))
        edges = written(small.select("e.*").where("a <> b").distinct(), "links")


def _follow(today: dict, name, met: set):
    while name in today and name not in met:
        met.add(name)
        name = today[name]
    return name


def canonical_paths(touches: DataFrame, renames: DataFrame, *repo: str) -> DataFrame:
    """``touches`` (repo..., pos, path, ...) with ``canonical``: the name as the renames before its line have it.

    ``repo`` names the columns that tell repositories apart: names of one say nothing about another. A task walks a
    family's renames and touches by line and holds that family's names only. A touch of a name that no rename has, or
    without a line, keeps its name.
    """
    ship(touches.sparkSession)
    own, schema = touches.columns, touches.schema
    code = lambda c: F.xxhash64(*repo, c)
    known = renames.select(*repo, "pos", "old_path", "new_path").dropna()
    family = families(known.select(code("old_path").alias("a"), code("new_path").alias("b")))
    walked = known.withColumn("_name", code("old_path")).join(family, "_name").select("_family", *repo, "pos", F.lit(1).alias("_kind"), F.col("old_path").alias("_old"), F.col("new_path").alias("_new"))
    placed = touches.withColumn("_name", F.when(F.col("pos").isNotNull(), code("path"))).join(family, "_name", "left")
    # Names without a rename are no one's family; they are dealt evenly.
    placed = placed.withColumn("_family", F.coalesce("_family", F.xxhash64("pos", "path")))
    rows = placed.select("_family", *own, F.lit(0).alias("_kind"), F.lit(None).cast("string").alias("_old"), F.lit(None).cast("string").alias("_new"))
    # At a line of its own a rename says nothing yet: touches come first.
    rows = rows.unionByName(walked, allowMissingColumns=True).repartition("_family").sortWithinPartitions("_family", "pos", "_kind", "_old", "_new")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, today = None, {}
        for batch in batches:
            plain = lambda c: batch.column(c).to_pylist()  # noqa: B023, E731
            out, repos = [], list(zip(*map(plain, repo), strict=True)) if repo else [()] * batch.num_rows
            for of, kind, path, old, new, where in zip(*map(plain, ("_family", "_kind", "path", "_old", "_new")), repos, strict=True):
                if of != current:
                    current, today = of, {}
                if kind:
                    today[where, old] = _follow(today, (where, new), set())
                else:
                    out.append(_follow(today, (where, path), set())[1])
            some = batch.filter(pc.equal(batch.column("_kind"), 0))
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in own), pa.array(out, pa.string())], names=[*own, "canonical"])

    return rows.mapInArrow(run, T.StructType([*schema.fields, T.StructField("canonical", T.StringType())]))
