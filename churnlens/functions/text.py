"""Column builders over log text and paths; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import BugfixDetection

#: Directories of tests, and extensions of code that should have tests.
TEST_DIRS = ("test", "tests", "__tests__", "spec", "specs", "testing")
CODE_EXTENSIONS = tuple("py java kt scala groovy js jsx mjs cjs ts tsx go rb rs cs php swift m c cc cpp cxx h hpp".split())


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalized_path(path) -> Column:
    return F.translate(col(path), "\\", "/")


def is_bugfix(message, config: BugfixDetection = BugfixDetection()) -> Column:
    """A fixing word anywhere in the first line, or a fixing verb with an issue reference."""
    first = F.substring_index(F.coalesce(col(message), F.lit("")), "\n", 1)
    return first.rlike(config.keyword_pattern) | first.rlike(config.issue_pattern)


def split_rename(raw) -> Column:
    """struct(old, new) of numstat's rename notations; both are the path itself where there is none."""
    raw = normalized_path(raw)
    braces = r"^(.*?)\{(.*?)=>(.*?)\}(.*)$"
    part = lambda i: F.regexp_extract(raw, braces, i)
    joined = lambda i: F.regexp_replace(F.regexp_replace(F.concat(part(1), F.trim(part(i)), part(4)), "/+", "/"), "^/", "")
    simple = lambda i: F.trim(F.regexp_extract(raw, r"^(.*?)=>(.*)$", i))
    side = lambda i, j: F.when(raw.rlike(braces), joined(i)).when(raw.contains("=>"), simple(j)).otherwise(raw)
    return F.struct(side(2, 1).alias("old"), side(3, 2).alias("new"))


def numstat_lines(body) -> Column:
    """array<struct(ord, added, deleted, raw)> of the lines with three tab-separated fields; binary files count 0."""
    count = lambda x: F.when(x == "-", F.lit(0)).otherwise(F.expr("0") + x.try_cast("int"))
    lines = F.transform(F.split(body, "\n"), lambda x, i: F.struct(i.alias("ord"), F.split(x, "\t").alias("f")))
    lines = F.filter(lines, lambda x: F.size(x["f"]) == 3)
    return F.transform(lines, lambda x: F.struct(x["ord"].alias("ord"), count(x["f"][0]).alias("added"), count(x["f"][1]).alias("deleted"), x["f"][2].alias("raw")))


def commit_instant(text) -> Column:
    """The instant; a corrupt offset keeps the wall clock as UTC; null where even that can't be read."""
    text = col(text)
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(F.concat(F.substring(text, 1, 19), F.lit("Z"))))


def commit_wall_clock(text) -> Column:
    return F.substring(col(text), 1, 19).try_cast("timestamp_ntz")


def base_name(path) -> Column:
    return F.substring_index(col(path), "/", -1)


def folder(path) -> Column:
    path = col(path)
    return F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/", 1)).otherwise("")


def in_test_dir(path) -> Column:
    parts = F.split(F.lower(folder(path)), "/")
    return F.arrays_overlap(parts, F.array(*map(F.lit, TEST_DIRS)))


def is_test_path(path) -> Column:
    name = base_name(path)
    stem = F.substring_index(name, ".", 1)
    return in_test_dir(path) | F.lower(name).rlike(r"\.(test|spec)\.") | stem.rlike(r"^test_|_test$|.Tests?$|^Test.")


def is_code_path(path) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]*)$", 1)).isin(*CODE_EXTENSIONS)


def candidate_test_names(path) -> Column:
    """Names a test of the file may have; the last is its own name, which counts in a test directory only."""
    name = base_name(path)
    stem, ext = F.regexp_extract(name, r"^(.*)\.([^.]*)$", 1), F.concat(F.lit("."), F.regexp_extract(name, r"^(.*)\.([^.]*)$", 2))
    # Usual namings of tests.
    shapes = (("test_", ""), ("", "_test"), ("", ".test"), ("", ".spec"), ("", "Test"), ("", "Tests"), ("Test", ""))
    return F.when(name.contains("."), F.array(*(F.concat(F.lit(a), stem, F.lit(b), ext) for a, b in shapes), name)).otherwise(F.array().cast("array<string>"))
