"""History per file: counts, ownership, percentiles, and running counts that never see their own commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Distribution, RiskWeights


def file_history(touches: DataFrame) -> DataFrame:
    return touches.groupBy("path").agg(
        F.count(F.lit(1)).alias("total_commits"), F.sum(F.col("is_bugfix").cast("long")).alias("bugfix_commits"), F.max("when_local").alias("last_changed")
    )


def author_history(touches: DataFrame) -> DataFrame:
    return touches.groupBy("path", "author").agg(F.count(F.lit(1)).alias("author_commits"))


def ownership(touches: DataFrame) -> DataFrame:
    """(path, author, author_commits, total_commits, ownership)."""
    per = author_history(touches)
    # The totals roll the per-author counts up again, so touches are read once.
    total = per.groupBy("path").agg(F.sum("author_commits").alias("total_commits"))
    return per.join(total, "path").withColumn("ownership", F.col("author_commits") / F.col("total_commits"))


def commits_per_author(touches: DataFrame) -> DataFrame:
    entries = F.sort_array(F.collect_list(F.struct("author", "author_commits")))
    return author_history(touches).groupBy("path").agg(F.map_from_entries(entries).alias("commits_per_author"))


def nearest_rank(values: DataFrame, column: str, quantiles: dict[str, float]) -> DataFrame:
    """One row with the elements at position round_half_even(q * (n - 1)) of the sorted values; 0 where there are none.

    Works on the distinct values' counts: only those meet in one task, not the rows.
    """
    counts = values.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = Window.orderBy("v")
    counts = counts.withColumns({"last": F.sum("c").over(upto) - 1, "n": F.sum("c").over(Window.partitionBy())})
    at = lambda q: F.bround(F.lit(q) * (F.col("n") - 1), 0)
    pick = [F.coalesce(F.min(F.when(F.col("last") >= at(q), F.col("v"))), F.lit(0)).cast("long").alias(name) for name, q in quantiles.items()]
    return counts.agg(*pick, F.coalesce(F.sum("c"), F.lit(0)).alias("n_values"))


def distribution(history: DataFrame, config: Distribution = Distribution()) -> DataFrame:
    """One row: percentiles of fixes (of files that have any) and of commits, and whether both samples are large enough."""
    fixes = nearest_rank(history.where("bugfix_commits > 0"), "bugfix_commits", {"bugfix_hot": config.hot, "bugfix_very_hot": config.very_hot})
    churn = nearest_rank(history, "total_commits", {"churn_high": config.churn})
    both = fixes.withColumnRenamed("n_values", "fixed_files").crossJoin(F.broadcast(churn.withColumnRenamed("n_values", "files")))
    return both.withColumn("meaningful", (F.col("files") >= config.min_files) & (F.col("fixed_files") >= config.min_files))


def calibrated(dist: DataFrame, weights: RiskWeights = RiskWeights(), config: Distribution = Distribution()) -> DataFrame:
    """One row of thresholds: the greater of the setting and the percentile, if the percentiles mean something."""
    use = F.col("meaningful") & F.lit(config.enabled)
    raised = lambda base, column: F.when(use, F.greatest(F.lit(base).cast("long"), F.col(column))).otherwise(F.lit(base).cast("long"))
    return dist.select(
        raised(weights.hot_bugfixes, "bugfix_hot").alias("hot_bugfixes"), raised(weights.very_hot_bugfixes, "bugfix_very_hot").alias("very_hot_bugfixes"),
        raised(weights.churn_commits, "churn_high").alias("churn_commits"), use.alias("relative_thresholds"),
    )


def _before(*keys: str):
    """All rows of the keys with a smaller sequence number: a RANGE frame, so rows of the same commit never count."""
    return Window.partitionBy(*keys).orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)


def running_history(touches: DataFrame) -> DataFrame:
    """Touches with prior_commits, prior_fixes and prior_by_author, all strictly before the commit."""
    none = F.lit(0).cast("long")
    return touches.withColumns(
        {
            "prior_commits": F.coalesce(F.count(F.lit(1)).over(_before("path")), none),
            "prior_fixes": F.coalesce(F.sum(F.col("is_bugfix").cast("long")).over(_before("path")), none),
            "prior_by_author": F.coalesce(F.count(F.lit(1)).over(_before("path", "author")), none),
        }
    )


def share(part: Column | str, whole: Column | str) -> Column:
    part, whole = (F.col(x) if isinstance(x, str) else x for x in (part, whole))
    return F.when(whole > 0, part.cast("double") / whole).otherwise(0.0)


def last_before() -> Column:
    """(seq, sha) of the latest earlier commit of a touch's path."""
    return F.max(F.struct("seq", "sha")).over(_before("path"))


def inducing(touches: DataFrame) -> DataFrame:
    """(fix_sha, path, inducing_sha): for each fixing touch the latest earlier commit of its path."""
    return touches.withColumn("inducing_sha", last_before()["sha"]).where("is_bugfix AND inducing_sha IS NOT NULL").select(F.col("sha").alias("fix_sha"), "path", "inducing_sha").distinct()


def labelled(commits: DataFrame, induced: DataFrame) -> DataFrame:
    """Commits with label 1 where a later fix points back at them."""
    bad = induced.select(F.col("inducing_sha").alias("sha"), F.lit(1).alias("label")).distinct()
    return commits.join(bad, "sha", "left").withColumn("label", F.coalesce("label", F.lit(0)))


def mining_summary(commits: DataFrame, induced: DataFrame) -> DataFrame:
    """One row: commits, fixes, distinct inducing commits, and those of them that are among the commits (the positives)."""
    bad = induced.select(F.col("inducing_sha").alias("sha")).distinct()
    counts = commits.agg(F.count(F.lit(1)).alias("commits"), F.count_if("is_bugfix").alias("fixes"))
    both = bad.join(commits.select("sha", F.lit(True).alias("known")), "sha", "left").agg(F.count(F.lit(1)).alias("inducing"), F.count_if("known").alias("positives"))
    return counts.crossJoin(F.broadcast(both))  # one row each
