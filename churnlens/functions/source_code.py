"""Imports and complexity of source files."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import ship
from .text import base_name


def python_references(path: str, source: str) -> list[str]:
    """Dotted names a Python file imports; none on a syntax error.

    ``from base import name`` offers both ``base`` and ``base.name``: only the index knows which is a module;
    a star offers ``base.*``, all modules right below. A relative import starts at the folder of the file (of an
    ``__init__`` file: the folder above its package) and gives nothing where it climbs beyond the root.
    """
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    folders = path.split("/")[:-1]
    if re.fullmatch(r"__init__\.pyi?", base_of(path)):
        folders = folders[:-1]
    found: dict[str, None] = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            found.update(dict.fromkeys(a.name for a in node.names))
        elif isinstance(node, ast.ImportFrom):
            up = max(node.level - 1, 0)
            if up > len(folders):
                continue
            start = folders[: len(folders) - up] if node.level else []
            base = ".".join([*start, *([node.module] if node.module else [])])
            if base:
                found.update(dict.fromkeys([base, *(f"{base}.{a.name}" for a in node.names)]))
    return list(found)


def base_of(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def python_imports(sources: DataFrame) -> DataFrame:
    """(src, ref) of the Python files in (path, source)."""
    ship(sources.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, r) for p, s in zip(frame["path"], frame["source"], strict=True) for r in python_references(p, s or "")]
            yield pd.DataFrame(rows, columns=["src", "ref"], dtype=object)

    return sources.where(F.col("path").rlike(r"\.pyi?$")).select("path", "source").mapInPandas(run, "src string, ref string")


def module_names(paths: DataFrame) -> DataFrame:
    """(name, path): every dotted suffix of a Python file's path; a package's own name for its __init__."""
    bare = F.regexp_replace(F.regexp_replace(F.col("path"), r"\.pyi?$", ""), "/__init__$", "")
    parts = F.split(bare, "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return paths.where(F.col("path").rlike(r"\.pyi?$")).select(F.explode(suffixes).alias("name"), "path").distinct()


def java_imports(sources: DataFrame) -> DataFrame:
    """(src, ref) of the Java files, by regular expressions in the JVM; a static import refers to its class."""
    java = sources.where(F.col("path").endswith(".java"))
    plain = F.expr(r"regexp_extract_all(source, '(?m)^\\s*import\\s+(?!static\\b)([\\w.]+(?:\\.\\*)?)\\s*;', 1)")
    static = F.expr(r"regexp_extract_all(source, '(?m)^\\s*import\\s+static\\s+([\\w.]+)\\.[\\w*]+\\s*;', 1)")
    return java.select(F.col("path").alias("src"), F.explode(F.array_union(plain, static)).alias("ref"))


def java_names(sources: DataFrame) -> DataFrame:
    """(name, path): package and class of each Java file."""
    java = sources.where(F.col("path").endswith(".java"))
    package = F.regexp_extract("source", r"(?m)^\s*package\s+([\w.]+)\s*;", 1)
    stem = F.regexp_replace(base_name("path"), r"\.java$", "")
    return java.select(F.when(package != "", F.concat(package, F.lit("."), stem)).otherwise(stem).alias("name"), "path")


class Parser(NamedTuple):
    """A language: (path, source) to (src, ref), to (name, path), and the endings of the paths it reads."""

    references: Callable[[DataFrame], DataFrame]
    names: Callable[[DataFrame], DataFrame]
    suffixes: tuple[str, ...]


#: Languages by registry name; further ones are added here.
PARSERS = {"python": Parser(python_imports, module_names, ("py", "pyi")), "java": Parser(java_imports, java_names, ("java",))}
#: Endings of the paths that any parser reads.
PARSED = tuple(x for p in PARSERS.values() for x in p.suffixes)


def parser_for(path) -> Column:
    """Registry name of the parser that reads a path, by its ending; null where none does."""
    ending = F.regexp_extract(path, r"\.([^./]*)$", 1)
    return F.coalesce(*(F.when(ending.isin(*p.suffixes), name) for name, p in PARSERS.items()))


_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.Assert)
_BRACE_BRANCH = re.compile(r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?")
_BRACE_FUNCTION = re.compile(r"\b[\w$]+\s*\([^;{}()]*\)\s*(?:throws[^{;]*|const\s*)?\{")
_KEYWORDS = frozenset("if for while switch catch return else do try synchronized".split())


def function_complexities(path: str, source: str) -> list[int] | None:
    """Cyclomatic complexity of each function; None where the language isn't known or the file can't be read."""
    if re.search(r"\.pyi?$", path):
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError, RecursionError):
            return None
        out = []
        for node in ast.walk(tree):
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                score = 1
                for x in ast.walk(node):
                    score += isinstance(x, _BRANCHES) + (len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0)
                out.append(score)
        return out
    if re.search(r"\.(java|kt|scala|groovy|[jt]sx?|[mc]js|go|rs|cs|php|swift|m|c|cc|cpp|cxx|h|hpp)$", path):
        plain = re.sub(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", " ", source, flags=re.S)
        out = []
        for m in _BRACE_FUNCTION.finditer(plain):
            if re.match(r"[\w$]+", m[0])[0] in _KEYWORDS:
                continue
            depth, at = 1, m.end()
            while at < len(plain) and depth:
                depth += (plain[at] == "{") - (plain[at] == "}")
                at += 1
            out.append(1 + len(_BRACE_BRANCH.findall(plain[m.end() : at])))
        return out
    return None


def complexity(sources: DataFrame) -> DataFrame:
    """(path, average_ccn, max_ccn, nloc, function_count); files that can't be judged have no row."""
    ship(sources.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, source in zip(frame["path"], frame["source"], strict=True):
                per = function_complexities(path, source or "")
                if per is not None:
                    lines = sum(bool(x.strip()) for x in (source or "").splitlines())
                    rows.append((path, round(sum(per) / len(per), 1) if per else 0.0, max(per, default=0), lines, len(per)))
            yield pd.DataFrame(rows, columns=["path", "average_ccn", "max_ccn", "nloc", "function_count"])

    return sources.select("path", "source").mapInPandas(run, "path string, average_ccn double, max_ccn int, nloc int, function_count int")
