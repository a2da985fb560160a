"""Commits, touches and other inputs made from order tables, so that every operator can run on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One commit per order. ``seq`` is a total order: seconds of the wall clock, then the key."""
    subject = """CASE CAST(o_orderkey % 8 AS INT)
      WHEN 0 THEN 'fix: off-by-one' WHEN 1 THEN 'Add pooling (#1234)' WHEN 2 THEN 'rename prefix and suffix' WHEN 3 THEN 'closes #123'
      WHEN 4 THEN 'Closes #123' WHEN 5 THEN 'resolved PROJ-42' WHEN 6 THEN 'Hotfix for prod' ELSE 'PROJ-42 add pagination' END"""
    base = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderkey").cast("string").alias("sha"), F.concat(F.lit("author_"), (F.col("o_custkey") % 40).cast("string")).alias("author"),
        F.expr("o_orderdate + make_dt_interval(0, 0, 0, CAST((o_orderkey * 7919) % 86400 AS INT))").alias("when_local"), F.expr(subject).alias("subject"),
    )
    seconds = F.unix_timestamp(F.col("when_local").cast("timestamp"))
    return base.withColumns({"is_bugfix": text.is_bugfix("subject"), "seq": seconds * F.lit(2147483648) + F.col("o_orderkey")})


def path_of(key: str) -> Column:
    """The path of a part's file; no two parts share one."""
    return F.expr(f"""CASE CAST({key} % 10 AS INT) WHEN 0 THEN concat('tests/test_m', {key} + 1, '.py') WHEN 9 THEN concat('docs/d', {key}, '.md')
                  ELSE concat('pkg', {key} % 25, '/m', {key}, '.py') END""")


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_partkey", path_of("l_partkey").alias("path"),
        F.col("l_quantity").cast("int").alias("lines_added"), F.round(F.col("l_discount") * 100).cast("int").alias("lines_deleted"),
    )
    return commits(spark, sf_dir).join(files, "o_orderkey")


def keyed_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``touches`` with keys of orders and parts in place of ``sha`` and ``path``, which shuffle and sort as longs."""
    return touches(spark, sf_dir).select(F.col("o_orderkey").alias("sha"), F.col("l_partkey").alias("path"), "seq", "author", "is_bugfix", "when_local", "lines_added", "lines_deleted")


def complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_partkey, max_ccn): a part's size; none where the key divides by 7."""
    return table(spark, sf_dir, "part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("max_ccn"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All distinct links from parts to suppliers; a supplier is the node of the part with its number."""
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return pairs.where("src <> dst").distinct()


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, seq, label, score): toxic labels scored by length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"), F.col("toxic").alias("label"), F.col("n_chars").cast("double").alias("score"))


def renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, old_path, new_path) of every part, newest first: all re-use an old name, half go there and back."""
    keys = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    path = lambda s: F.concat(F.lit("r"), F.col("k").cast("string"), F.lit(s))
    first = keys.select((F.col("k") * 3).alias("pos"), path("/a.py").alias("old_path"), path("/b.py").alias("new_path"))
    second = keys.select((F.col("k") * 3 + 900).alias("pos"), path("/c.py").alias("old_path"), path("/a.py").alias("new_path"))
    third = keys.where("k % 100 < 50").select((F.col("k") * 3 + 1800).alias("pos"), path("/a.py").alias("old_path"), path("/c.py").alias("new_path"))
    return first.unionByName(second).unionByName(third)
