"""The feature vector of a change: twenty numbers, in a fixed order, of what was known before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .history import share

#: Names, in order, with their labels.
FEATURES = {
    "lines_added": "Lines added", "lines_deleted": "Lines deleted", "lines_changed": "Size of the change", "files_changed": "Number of files touched",
    "folders_touched": "Spread across folders", "max_file_commits": "Change history of the busiest file", "mean_file_commits": "Average change history of the files touched",
    "max_file_bugfixes": "Bug-fix history of the worst file", "mean_file_bugfixes": "Average bug-fix history of the files touched", "new_files": "Brand-new files",
    "min_author_ownership": "Author's familiarity with the file they know least", "mean_author_ownership": "Author's familiarity with these files",
    "files_author_never_touched": "Files the author has never changed", "max_complexity": "Complexity of the most complex file",
    "mean_complexity": "Average complexity of the files touched", "code_files_changed": "Source files touched", "test_files_changed": "Test files touched",
    "hour_of_day": "Hour of day", "day_of_week": "Day of week", "is_weekend": "Weekend",
}


def feature_vector(rows: DataFrame, *key: str) -> DataFrame:
    """``rows``: touches with prior_* counts and max_ccn (null: unknown); one aggregation per change, by ``key`` (sha)."""
    known = F.col("prior_commits") > 0
    with_history = lambda c: F.when(known, c)
    zero = lambda c: F.coalesce(c, F.lit(0.0)).cast("double")
    owned = with_history(share("prior_by_author", "prior_commits"))
    one = lambda c: F.count_if(c).cast("double")
    when = F.first("when_local")
    return rows.groupBy(*(key or ("sha",))).agg(
        zero(F.sum("lines_added")).alias("lines_added"), zero(F.sum("lines_deleted")).alias("lines_deleted"),
        zero(F.sum(F.col("lines_added") + F.col("lines_deleted"))).alias("lines_changed"), F.count(F.lit(1)).cast("double").alias("files_changed"),
        F.count_distinct(text.folder("path")).cast("double").alias("folders_touched"),
        zero(F.max(with_history(F.col("prior_commits")))).alias("max_file_commits"), zero(F.avg(with_history(F.col("prior_commits")))).alias("mean_file_commits"),
        zero(F.max(with_history(F.col("prior_fixes")))).alias("max_file_bugfixes"), zero(F.avg(with_history(F.col("prior_fixes")))).alias("mean_file_bugfixes"),
        one(~known).alias("new_files"), zero(F.min(owned)).alias("min_author_ownership"), zero(F.avg(owned)).alias("mean_author_ownership"),
        one(known & (F.col("prior_by_author") == 0)).alias("files_author_never_touched"),
        zero(F.max("max_ccn")).alias("max_complexity"), zero(F.avg("max_ccn")).alias("mean_complexity"),
        one(text.is_code_path("path")).alias("code_files_changed"), one(text.is_test_path("path")).alias("test_files_changed"),
        F.hour(when).cast("double").alias("hour_of_day"), F.weekday(when).cast("double").alias("day_of_week"), (F.weekday(when) >= 5).cast("double").alias("is_weekend"),
    )


def timing(commits: DataFrame) -> DataFrame:
    day = F.weekday("when_local")
    return commits.select("sha", F.hour("when_local").alias("hour_of_day"), day.alias("day_of_week"), (day >= 5).cast("int").alias("is_weekend"))
