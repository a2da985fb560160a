"""Rank metrics and time splits. Running totals are taken in ranges of the order, so no task meets all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.storage import cut


def running_totals(rows: DataFrame, order: str, sums: dict[str, str]) -> DataFrame:
    """Adds ``new = sum of old over all rows up to this one`` by ``order`` (distinct values) for each new: old of ``sums``.

    Rows are dealt to ranges of ``order``; each range is summed on its own, and the totals of the ranges
    before it, one row each, are added.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(parts, order).withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy("_range").agg(*(F.sum(old).alias(f"_{new}") for new, old in sums.items()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_range", *(F.coalesce(F.sum(f"_{new}").over(before), F.lit(0)).alias(f"_{new}") for new in sums))
    inside = Window.partitionBy("_range").orderBy(order)
    out = dealt.withColumns({new: F.sum(old).over(inside) for new, old in sums.items()})
    out = out.join(F.broadcast(totals), "_range")  # one row per range
    return out.withColumns({new: F.col(new) + F.col(f"_{new}") for new in sums}).drop("_range", *(f"_{new}" for new in sums))


def _by_score(scored: DataFrame) -> DataFrame:
    return scored.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """One row: roc_auc by rank sum, ties at their mean rank; NaN with one class only."""
    per = running_totals(_by_score(scored), "score", {"upto": "n"})
    rank = F.col("upto") - F.col("n") + (F.col("n") + 1) / 2
    total = per.agg(F.sum(F.col("pos") * rank).alias("ranks"), F.sum("pos").cast("double").alias("p"), F.sum(F.col("n") - F.col("pos")).cast("double").alias("q"))
    value = (F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))
    return total.select(F.when((F.col("p") > 0) & (F.col("q") > 0), value).otherwise(F.lit(float("nan"))).alias("roc_auc"))


def pr_auc(scored: DataFrame) -> DataFrame:
    """One row: average precision with a step at each distinct score; NaN without positives."""
    per = running_totals(_by_score(scored), "score", {"pos_upto": "pos", "n_upto": "n"})
    total = per.agg(F.sum("pos").alias("all"), F.sum("n").alias("rows"))
    # From the highest score down: what is not below a score.
    tp, seen = F.col("all") - F.col("pos_upto") + F.col("pos"), F.col("rows") - F.col("n_upto") + F.col("n")
    steps = per.join(F.broadcast(total)).agg(F.sum(F.when(F.col("all") > 0, F.col("pos") / F.col("all") * (tp / seen))).alias("v"))
    return steps.select(F.coalesce("v", F.lit(float("nan"))).alias("pr_auc"))


def time_split(rows: DataFrame, fraction: float, *order: str) -> DataFrame:
    """Adds ``is_train``: the oldest rows by ``order``; at least one row on either side (a single row trains).

    The border is found from counts per distinct leading value; only rows that share the border
    value are ranked one by one.
    """
    first = order[0]
    counts = running_totals(rows.groupBy(F.col(first).alias("_v")).agg(F.count(F.lit(1)).alias("_c")), "_v", {"_until": "_c"})
    total = counts.agg(F.sum("_c").alias("_n"))
    size = F.greatest(F.lit(1).cast("long"), F.least(F.floor(F.col("_n") * F.lit(fraction)), F.col("_n") - 1))
    border = counts.join(F.broadcast(total)).where((F.col("_until") >= size) & (F.col("_until") - F.col("_c") < size))
    border = border.select(F.col("_v").alias("_border"), (size - (F.col("_until") - F.col("_c"))).alias("_room"))
    # One row at most: the border; rows of an empty table meet none.
    placed = rows.join(F.broadcast(border))
    at_border = placed.where(F.col(first) == F.col("_border")).withColumn("is_train", F.row_number().over(Window.partitionBy("_border").orderBy(*order)) <= F.col("_room"))
    others = placed.where(F.col(first) != F.col("_border")).withColumn("is_train", F.col(first) < F.col("_border"))
    return at_border.unionByName(others).drop("_border", "_room")


def class_weight(labels: DataFrame) -> DataFrame:
    """One row: max(1, negatives / positives); null without positives (training refuses that)."""
    pos = F.sum("label")
    return labels.agg(F.when(pos > 0, F.greatest(F.lit(1.0), (F.count(F.lit(1)) - pos) / pos)).alias("class_weight"))


def base_rate(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("positives"), F.try_divide(F.sum("label").cast("double"), F.count(F.lit(1))).alias("base_rate"))
