"""Which tests belong to a file, and which of them a change touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def matched_tests(wanted: DataFrame, repo_paths: DataFrame) -> DataFrame:
    """(path, test_path): code files joined on the names their tests may have."""
    code = wanted.select("path").distinct().where(text.is_code_path("path") & ~text.is_test_path("path"))
    names = code.select("path", F.explode(text.candidate_test_names("path")).alias("name"))
    tests = repo_paths.select(F.col("path").alias("test_path")).distinct().where(text.is_test_path("test_path"))
    tests = tests.withColumn("name", text.base_name("test_path"))
    found = names.join(tests, "name").where(F.col("path") != F.col("test_path"))
    return found.where((F.col("name") != text.base_name("path")) | text.in_test_dir("test_path")).select("path", "test_path").distinct()


def with_tests(changed: DataFrame, repo_paths: DataFrame, key: str = "sha") -> DataFrame:
    """Changed files with is_test, is_code, tests (sorted) and tests_changed (of the same change)."""
    pairs = matched_tests(changed, repo_paths)
    tests = pairs.groupBy("path").agg(F.sort_array(F.collect_set("test_path")).alias("tests"))
    touched = changed.select(key, F.col("path").alias("test_path")).distinct()
    fresh = changed.select(key, "path").distinct().join(pairs, "path").join(touched, [key, "test_path"], "left_semi").select(key, "path").distinct().withColumn("tests_changed", F.lit(True))
    out = changed.join(tests, "path", "left").join(fresh, [key, "path"], "left")
    empty = F.array().cast("array<string>")
    return out.withColumns({"is_test": text.is_test_path("path"), "is_code": text.is_code_path("path"), "tests": F.coalesce("tests", empty), "tests_changed": F.coalesce("tests_changed", F.lit(False))})
