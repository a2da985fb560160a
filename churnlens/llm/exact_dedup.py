"""Exact dedup by a tree-merge of sorted digest runs.

Every input partition turns its rows into one run: its distinct digests with the best row and the
number of rows of each. Runs are then exchanged in binomial rounds. With ``P = fan_in ** rounds``
nodes, round ``k`` sends an entry to the node that agrees with its present node in all base-``fan_in``
digits but the ``k``-th, which becomes that of its digest; there up to ``fan_in`` runs are merged and
only the best identifier of each digest goes on. After the last round a node holds one range of the
digest space from all partitions. A digest that every partition holds is cut by ``fan_in`` in each
round, so no node ever receives more than ``fan_in`` entries of it, and no node ever holds the whole.

Digests are verified: entries merge only if SHA-256, the normalised length and an independent 64-bit
hash of the normalised text all agree.

Defined results: a null text counts as empty; all empty texts are one group; a null ``doc_id`` sorts
after every other and is kept only if its group has no other id among its longest rows; of repeated
rows exactly one is kept; an empty table gives an empty result; further columns are ignored by
``exact_groups`` and passed on by ``drop_exact_copies``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE_CLASS, fresh, stored

KEY = ["sha", "n", "check"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE_CLASS}]+", "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per input row: id, row number, digest key and length. Texts are read once."""
    norm = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.length(text_col), F.lit(0)).alias("chars"), normalised(F.col(text_col)).alias("norm"))
    return stored(
        norm.select(
            "doc_id", F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("part"), "chars",
            F.unhex(F.sha2("norm", 256)).alias("sha"), F.length("norm").alias("n"), F.xxhash64("norm").alias("check"),
        ),
        "digests",
    )


def tree_merge(rows: DataFrame, leaves: int, fan_in: int = 16) -> DataFrame:
    """(sha, n, check) -> best row and group size, merged in binomial rounds over ``leaves`` runs."""
    rounds = max(1, math.ceil(math.log(max(leaves, 2), fan_in) - 1e-9))
    nodes = fan_in**rounds
    # ~x falls as x grows and cannot overflow: the greatest struct is the longest text, then the smallest id.
    best = F.struct("chars", F.col("doc_id").isNotNull().alias("has_id"), F.bitwise_not("doc_id").alias("id"), F.bitwise_not("row").alias("row"))
    merged = rows.select(F.pmod("part", F.lit(nodes)).cast("long").alias("node"), *KEY, F.lit(1).cast("long").alias("size"), best.alias("best"))
    home = F.pmod(F.xxhash64(*KEY), F.lit(nodes))
    for k in range(rounds):
        step = fan_in**k
        digit = lambda c: F.pmod(F.floor(c / F.lit(step)), F.lit(fan_in))  # noqa: E731, B023
        target = F.col("node") + (digit(home) - digit(F.col("node"))) * F.lit(step)
        # Partial aggregation is the run of a sender, final aggregation the multiway merge of a node.
        merged = merged.groupBy(target.alias("node"), *KEY).agg(F.max("best").alias("best"), F.sum("size").alias("size"))
    return merged.select(*KEY, F.bitwise_not("best.id").alias("keep_id"), F.bitwise_not("best.row").alias("keep_row"), F.col("size").alias("group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16) -> DataFrame:
    """Per input row: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Of equal texts (after deleting ASCII white space) the row with most code points, then the smallest
    id, stays. At most ``fan_in`` runs meet in one merge.
    """
    rows = digests(docs, id_col, text_col)
    leaves = (rows.agg(F.max("part")).first()[0] or 0) + 1
    groups = tree_merge(rows, leaves, fan_in)
    # The rows of a hot group all meet its one entry here: a plain equi-join, which adaptive execution splits.
    return rows.join(groups, KEY).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16) -> DataFrame:
    """``docs`` without the copies; all its columns stay. Of repeated rows one stays."""
    columns = docs.columns
    kept = exact_groups(docs, id_col, text_col, fan_in).where("kept")
    id_key, sha, rank = (fresh(columns, x) for x in ("_id_key", "_sha", "_rank"))
    as_key = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    kept = kept.select(as_key(F.col("doc_id")).alias(id_key), F.col("text_sha256").alias(sha))
    keyed = docs.withColumns({id_key: as_key(docs[id_col]), sha: F.sha2(normalised(docs[text_col]), 256)})
    first = Window.partitionBy(id_key, sha).orderBy(F.length(text_col).desc_nulls_last())
    return keyed.join(kept, [id_key, sha], "left_semi").withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).select(*columns)
