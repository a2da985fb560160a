"""Points rules as nullable reason structs: a registry of column builders that code generation covers whole.

A file's score is the capped sum of its reasons' points; a change's score is its riskiest file's plus
what the change itself adds, capped. Reasons are ordered by points, ties by rule order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import RiskWeights
from .history import share

REASON = "struct<neg:int,ord:int,rule:string,label:string,points:int,detail:string,path:string>"

#: Advice per rule and per model feature, and a headline per band.
HINTS = {
    "missing_tests": "add a test for the changed file before shipping",
    "stale_tests": "the tests for this file were not touched — check they still cover it",
    "hot_file": "this file has been fixed repeatedly; deploy where you can roll back fast",
    "high_complexity": "the most complex function here deserves a second reviewer",
    "author_new_to_file": "ask someone who has worked in this file to review",
    "low_ownership": "loop in the file's main author",
    "large_edit": "consider splitting this into smaller, separately deployable changes",
    "broad_change": "this touches a lot of the tree — stage the rollout",
    "weekend_deploy": "avoid shipping when the people who can fix it are away",
    "late_night_deploy": "hold until working hours if you can",
    "churn": "this file changes constantly; expect it to need another change soon",
    "model:max_file_bugfixes": "these files have been fixed repeatedly; keep a rollback ready",
    "model:mean_file_bugfixes": "the files touched have a poor track record; deploy carefully",
    "model:lines_changed": "consider splitting this into smaller, separately deployable changes",
    "model:lines_added": "consider splitting this into smaller, separately deployable changes",
    "model:files_changed": "this touches a lot of the tree — stage the rollout",
    "model:folders_touched": "the change spans several areas; check each one has an owner",
    "model:test_files_changed": "add or update tests alongside this change",
    "model:code_files_changed": "review each source file touched, not just the diff summary",
    "model:files_author_never_touched": "ask someone who has worked in these files to review",
    "model:min_author_ownership": "loop in the main author of the least familiar file",
    "model:mean_author_ownership": "get a review from someone who knows this area",
    "model:max_complexity": "the most complex function here deserves a second reviewer",
    "model:max_file_commits": "these files change constantly; expect another change soon",
    "model:is_weekend": "avoid shipping when the people who can fix it are away",
    "model:hour_of_day": "hold until working hours if you can",
    "model:new_files": "new files have no track record — watch them after release",
}
HEADLINES = {
    "low": "Safe to deploy with a normal review.",
    "medium": "Deployable, but review it properly and watch it after release.",
    "high": "Hold this, or ship it behind a flag with a rollback ready.",
}


def _text(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) and not isinstance(p, str) else F.lit(p) for p in parts))


def _s(name: str) -> Column:
    return F.col(name).cast("string")


def reason(order: int, rule: str, label: str, points: int, detail: Column, path: Column | None = None) -> Column:
    path = F.lit(None).cast("string") if path is None else path
    return F.struct(
        F.lit(-points).alias("neg"), F.lit(order).alias("ord"), F.lit(rule).alias("rule"), F.lit(label).alias("label"), F.lit(points).alias("points"), detail.alias("detail"), path.alias("path")
    )


def hot_file(w: RiskWeights) -> Column:
    fixes, path = F.col("prior_fixes"), F.col("path")
    detail = lambda limit: _text(_s("prior_fixes"), " past bug-fix commits (threshold ", _s(limit), ")")
    return F.when(
        (F.col("prior_commits") > 0) & (fixes >= F.col("very_hot_bugfixes")),
        reason(10, "hot_file", "File has a long history of bug fixes", w.very_hot_points, detail("very_hot_bugfixes"), path),
    ).when((F.col("prior_commits") > 0) & (fixes >= F.col("hot_bugfixes")), reason(10, "hot_file", "File has needed bug fixes before", w.hot_points, detail("hot_bugfixes"), path))


def tests(w: RiskWeights) -> Column:
    code = F.col("is_code") & ~F.col("is_test")
    missing = reason(11, "missing_tests", "No test file found for this file", w.no_test_file_points, F.lit("searched the usual naming conventions and test directories"), F.col("path"))
    stale = reason(11, "stale_tests", "Tests exist but were not changed", w.stale_test_points, _text("unchanged: ", F.array_join(F.slice("tests", 1, 3), ", ")), F.col("path"))
    return F.when(code & (F.size("tests") == 0), missing).when(code & ~F.col("tests_changed"), stale)


def complexity(w: RiskWeights) -> Column:
    detail = lambda limit: _text("peak cyclomatic complexity ", _s("max_ccn"), f" (threshold {limit})")
    return F.when(
        F.col("max_ccn") >= w.very_high_ccn, reason(12, "high_complexity", "Contains a very complex function", w.very_high_ccn_points, detail(w.very_high_ccn), F.col("path"))
    ).when(F.col("max_ccn") >= w.high_ccn, reason(12, "high_complexity", "Contains a complex function", w.high_ccn_points, detail(w.high_ccn), F.col("path")))


def familiarity(w: RiskWeights) -> Column:
    owned = share("prior_by_author", "prior_commits")
    percent = F.bround(owned * 100, 0).cast("int").cast("string")
    new = _text(F.col("author"), " has 0 of its ", _s("prior_commits"), " past commits")
    low = _text(F.col("author"), " made ", _s("prior_by_author"), " of ", _s("prior_commits"), " past commits (", percent, "%)")
    known = F.col("prior_commits") > 0
    return F.when(
        known & (F.col("prior_by_author") == 0), reason(13, "author_new_to_file", "Author has never changed this file before", w.new_to_file_points, new, F.col("path"))
    ).when(known & (owned < w.low_ownership), reason(13, "low_ownership", "Author knows this file only slightly", w.low_ownership_points, low, F.col("path")))


def large_edit(w: RiskWeights) -> Column:
    lines = F.col("lines_added") + F.col("lines_deleted")
    detail = lambda limit: _text(lines.cast("string"), f" lines changed (threshold {limit})")
    return F.when(lines >= w.file_large_lines, reason(14, "large_edit", "Large edit to a single file", w.file_large_points, detail(w.file_large_lines), F.col("path"))).when(
        lines >= w.file_moderate_lines, reason(14, "large_edit", "Sizeable edit to a single file", w.file_moderate_points, detail(w.file_moderate_lines), F.col("path"))
    )


def churn(w: RiskWeights) -> Column:
    detail = _text(_s("prior_commits"), " commits touched it (threshold ", _s("churn_commits"), ")")
    return F.when((F.col("prior_commits") > 0) & (F.col("prior_commits") >= F.col("churn_commits")), reason(15, "churn", "File changes very frequently", w.churn_points, detail, F.col("path")))


FILE_RULES = {"hot_file": hot_file, "tests": tests, "complexity": complexity, "familiarity": familiarity, "large_edit": large_edit, "churn": churn}


def broad_files(w: RiskWeights) -> Column:
    return F.when(F.col("n_files") >= w.broad_files, reason(0, "broad_change", "Change touches many files", w.broad_files_points, _text(_s("n_files"), f" files (threshold {w.broad_files})")))


def broad_lines(w: RiskWeights) -> Column:
    return F.when(F.col("n_lines") >= w.broad_lines, reason(1, "broad_change", "Change is large overall", w.broad_lines_points, _text(_s("n_lines"), " lines across ", _s("n_files"), " files")))


def weekend(w: RiskWeights) -> Column:
    return F.when(F.weekday("when_local") >= 5, reason(2, "weekend_deploy", "Shipping at the weekend", w.weekend_points, F.date_format("when_local", "EEEE HH:mm")))


def late_night(w: RiskWeights) -> Column:
    hour = F.hour("when_local")
    late = (hour >= w.late_night_start_hour) | (hour < w.late_night_end_hour)
    return F.when(late, reason(3, "late_night_deploy", "Shipping outside working hours", w.late_night_points, F.date_format("when_local", "EEEE HH:mm")))


CHANGE_RULES = {"broad_files": broad_files, "broad_lines": broad_lines, "weekend": weekend, "late_night": late_night}


def band(score: Column, w: RiskWeights = RiskWeights()) -> Column:
    return F.when(score >= w.high_band_score, "high").when(score >= w.medium_band_score, "medium").otherwise("low")


def _fired(rules: dict, w: RiskWeights) -> Column:
    return F.array_sort(F.array_compact(F.array(*(rule(w).cast(REASON) for rule in rules.values()))))


def _capped(reasons: str, w: RiskWeights, base: Column | None = None) -> Column:
    return F.least(F.lit(w.max_score), F.aggregate(reasons, F.lit(0), lambda a, r: a + r["points"]) + (F.lit(0) if base is None else base))


def score_files(files: DataFrame, w: RiskWeights = RiskWeights()) -> DataFrame:
    """Adds reasons, score and band; thresholds come as columns (see ``calibrated``)."""
    return files.withColumn("reasons", _fired(FILE_RULES, w)).withColumn("score", _capped("reasons", w)).withColumn("band", band(F.col("score"), w))


def ranked(files: DataFrame, key: str = "sha") -> DataFrame:
    return files.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "path")))


def recommend(band_column: Column, reasons: Column, most: int = 2) -> Column:
    hints = F.create_map(*(F.lit(x) for pair in HINTS.items() for x in pair))
    found = F.slice(F.array_distinct(F.array_compact(F.transform(reasons, lambda r: F.element_at(hints, r["rule"])))), 1, most)
    head = F.element_at(F.create_map(*(F.lit(x) for pair in HEADLINES.items() for x in pair)), band_column)
    return F.when(F.size(found) == 0, head).otherwise(F.concat(head, F.lit(" Suggested: "), F.array_join(found, "; "), F.lit(".")))


def score_changes(files: DataFrame, w: RiskWeights = RiskWeights(), key: str = "sha", change_rules: bool = True) -> DataFrame:
    """One row per change from its scored files: score, band, reasons, files (riskiest first), recommendation."""
    item = F.struct((-F.col("score")).alias("neg"), "path", "score", "band", "lines_added", "lines_deleted", "reasons")
    per = files.groupBy(key).agg(
        F.sort_array(F.collect_list(item)).alias("files"), F.count(F.lit(1)).alias("n_files"), F.sum(F.col("lines_added") + F.col("lines_deleted")).alias("n_lines"),
        F.first("when_local").alias("when_local"), F.first("author").alias("author"),
    )
    context = _fired(CHANGE_RULES, w) if change_rules else F.array().cast(f"array<{REASON}>")
    per = per.withColumn("context", context).withColumn("score", _capped("context", w, F.col("files")[0]["score"]))
    per = per.withColumn("band", band(F.col("score"), w)).withColumn("reasons", F.array_sort(F.concat("context", F.col("files")[0]["reasons"])))
    return per.withColumn("recommendation", recommend(F.col("band"), F.col("reasons"))).drop("context")
