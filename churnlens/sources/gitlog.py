"""Version-control sources: Python data sources over the ``git`` binary, and the same log text from files."""

from __future__ import annotations

import subprocess
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from ..functions import text
from ..plans.storage import cut, ship

#: Separators of records and fields in the log text.
RECORD, FIELD = "\x1e", "\x1f"
_FORMAT = f"--format={RECORD}%H{FIELD}%an{FIELD}%aI{FIELD}%s"


def git(repo: str, *arguments: str) -> str:
    """Paths are printed as they are, not quoted."""
    done = subprocess.run(["git", "-c", "core.quotePath=false", "-C", repo, *arguments], capture_output=True, check=True)
    return done.stdout.decode("utf-8", "replace")


def resolve_base(repo: str, base: str | None = None) -> tuple[str, str]:
    """(reference, merge base with HEAD) of the given or the default branch."""
    names = [base] if base else []
    if not base:
        try:
            names.append(git(repo, "symbolic-ref", "--short", "refs/remotes/origin/HEAD").strip())
        except subprocess.CalledProcessError:
            pass
        # Usual names of default branches, local ones first.
        for name in ("main", "master", "develop", "trunk"):
            names += [name, f"origin/{name}"]
    for name in names:
        try:
            git(repo, "rev-parse", "--verify", "--quiet", f"{name}^{{commit}}")
            return name, git(repo, "merge-base", name, "HEAD").strip()
        except subprocess.CalledProcessError:
            continue
    raise ValueError(f"no base branch found in {repo}")


def blobs(repo: str, ref: str, max_bytes: int):
    """(path, text) of a tree's files up to ``max_bytes``, by two processes however many files there are."""
    listing = git(repo, "ls-tree", "-r", "-l", "-z", ref)
    wanted = []
    for entry in listing.split("\0"):
        facts, _, path = entry.partition("\t")
        if path and facts.split()[1] == "blob" and int(facts.split()[3]) <= max_bytes:
            wanted.append((path, facts.split()[2]))
    with tempfile.TemporaryFile() as asked:  # read by the process as it goes, so neither side waits for the other
        asked.write("".join(f"{name}\n" for _, name in wanted).encode())
        asked.seek(0)
        with subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=asked, stdout=subprocess.PIPE) as answers:
            for path, _ in wanted:
                size = int(answers.stdout.readline().split()[2])
                content = answers.stdout.read(size)
                answers.stdout.read(1)
                yield path, content.decode("utf-8", "replace")


class _Reader(DataSourceReader):
    def __init__(self, kind: str, options):
        self.kind, self.options = kind, dict(options)

    def partitions(self):
        return [InputPartition(repo) for repo in self.options["path"].split(",")]

    def read(self, partition):
        repo, option = partition.value, self.options.get
        if self.kind == "gitlog":
            limit = [f"--max-count={option('max_commits')}"] if option("max_commits") else []
            try:
                log = git(repo, "log", "--no-merges", "--numstat", _FORMAT, *limit, option("until") or "HEAD")
            except subprocess.CalledProcessError:
                return  # no commits yet
            for pos, record in enumerate(x for x in log.split(RECORD) if x.strip()):
                yield repo, pos, record
        elif self.kind == "gitdiff":
            for pos, line in enumerate(git(repo, "diff", "--numstat", *(x for x in (option("base"), option("head")) if x)).splitlines()):
                yield repo, pos, line
        elif self.kind == "gitfiles":
            listing = git(repo, "ls-tree", "-r", "--name-only", option("ref")) if option("ref") else git(repo, "ls-files", *(["--others", "--exclude-standard"] if option("untracked") else []))
            for pos, line in enumerate(listing.splitlines()):
                yield repo, pos, line
        else:
            for pos, (path, content) in enumerate(blobs(repo, option("ref") or "HEAD", int(option("max_bytes") or 400_000))):
                yield repo, pos, path + FIELD + content


def _source(kind: str) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls):
            return kind

        def schema(self):
            return "repo string, pos long, line string"

        def reader(self, schema):
            return _Reader(kind, self.options)

    Source.__name__ = kind
    return Source


KINDS = ("gitlog", "gitdiff", "gitfiles", "gitblob")


def register(spark: SparkSession) -> None:
    """Makes the formats ``gitlog``, ``gitdiff``, ``gitfiles`` and ``gitblob`` known; options: path (repositories, comma-joined), until, max_commits, base, head, ref, untracked, max_bytes."""
    ship(spark)
    for kind in KINDS:
        spark.dataSource.register(_source(kind))


def log_text(spark: SparkSession, path: str) -> DataFrame:
    """(repo, pos, line) of log text that lies in files already."""
    # A row per record; the block's start and the place in its partition order the records of a file.
    rows = spark.read.option("lineSep", RECORD).text(path).select(F.input_file_name().alias("repo"), F.monotonically_increasing_id().alias("at"), F.input_file_block_start().alias("block"), F.col("value").alias("line"))
    rows = cut(rows.where(F.trim("line") != ""))
    order = Window.partitionBy("repo").orderBy("block", "at")
    return rows.select("repo", (F.row_number().over(order) - 1).cast("long").alias("pos"), "line")


def log_stats(records: DataFrame, max_commits: int | None = None) -> DataFrame:
    """Per repository: records read, those left out as unreadable, and whether the limit was reached (an exact fit counts)."""
    fields = _fields(records)
    bad = (F.size("f") != 4) | text.commit_instant(F.try_element_at("f", F.lit(3))).isNull()
    per = fields.groupBy("repo").agg(F.count(F.lit(1)).alias("records"), F.count_if(bad).alias("skipped"))
    return per.withColumn("truncated", F.col("records") >= max_commits if max_commits else F.lit(False))


def _fields(records: DataFrame) -> DataFrame:
    return records.withColumn("f", F.split(F.substring_index("line", "\n", 1), FIELD))


def parse_log(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(commits, touches) of raw records, newest first; records without four fields or a readable date are left out.

    A touch has ``pos``, a number that counts numstat lines newest first, and ``old_path`` where it is a rename.
    """
    parsed = _fields(records).withColumn("body", F.regexp_replace("line", r"^[^\n]*\n?", "")).where(F.size("f") == 4)
    parsed = parsed.select(
        "repo", F.col("pos").alias("record"), F.col("f")[0].alias("sha"), F.when(F.col("f")[1] == "", "unknown").otherwise(F.col("f")[1]).alias("author"),
        text.commit_instant(F.col("f")[2]).alias("when_ts"), text.commit_wall_clock(F.col("f")[2]).alias("when_local"), F.col("f")[3].alias("subject"), "body",
    ).where("when_ts IS NOT NULL")
    last = F.max("record").over(Window.partitionBy("repo"))
    parsed = cut(parsed.withColumns({"is_bugfix": text.is_bugfix("subject"), "seq": last - F.col("record")}))
    lines = parsed.select("repo", "sha", "seq", "author", "when_local", "is_bugfix", "record", F.inline(text.numstat_lines(F.col("body"))))
    lines = lines.withColumn("r", text.split_rename("raw")).select(
        "repo", "sha", "seq", "author", "when_local", "is_bugfix", (F.col("record") * 1_000_000 + F.col("ord")).alias("pos"), F.col("r.new").alias("path"),
        F.when(F.col("r.old") != F.col("r.new"), F.col("r.old")).alias("old_path"), F.col("added").alias("lines_added"), F.col("deleted").alias("lines_deleted"),
    )
    return parsed.drop("body", "record"), lines


def read_records(spark: SparkSession, repos: str, until: str | None = None, max_commits: int | None = None) -> DataFrame:
    """(repo, pos, line): the raw records of repositories' logs."""
    register(spark)
    reader = spark.read.format("gitlog").option("path", repos)
    for key, value in (("until", until), ("max_commits", max_commits)):
        reader = reader.option(key, value) if value else reader
    return cut(reader.load())


def followed(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(commits, touches) of raw records; touches carry the names files have today."""
    from ..operators.renames import canonical_paths

    commits, touches = parse_log(records)
    renames = touches.where("old_path IS NOT NULL").select("repo", "pos", "old_path", F.col("path").alias("new_path"))
    return commits, canonical_paths(touches, renames, "repo").drop("path").withColumnRenamed("canonical", "path")


def read_log(spark: SparkSession, repos: str, until: str | None = None, max_commits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(commits, touches) of repositories."""
    return followed(read_records(spark, repos, until, max_commits))


def complexity_then(touches: DataFrame, parallel: int = 64) -> DataFrame:
    """(repo, sha, path, max_ccn): the complexity that code files had at each commit that touched them.

    Files are looked up by the names they have today, so a file that has since been renamed has none.
    Equal contents are judged once a task.
    """
    import pandas as pd

    from ..functions.source_code import function_complexities

    def run(frames):
        known: dict[tuple[str, str], int | None] = {}
        for frame in frames:
            for repo, part in frame.groupby("repo"):
                with tempfile.TemporaryFile() as asked:
                    asked.write("".join(f"{s}:{p}\n" for s, p in zip(part["sha"], part["path"], strict=True)).encode())
                    asked.seek(0)
                    found = []
                    with subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=asked, stdout=subprocess.PIPE) as answers:
                        for path in part["path"]:
                            head = answers.stdout.readline().decode("utf-8", "replace").rstrip("\n")
                            fields = head.split(" ")
                            if len(fields) != 3 or fields[-1] == "missing" or not fields[2].isdigit():
                                found.append(None)
                                continue
                            content = answers.stdout.read(int(fields[2]))
                            answers.stdout.read(1)
                            key = (fields[0], base_name_of(path))
                            if key not in known:
                                per = function_complexities(path, content.decode("utf-8", "replace")) if fields[1] == "blob" else None
                                known[key] = max(per) if per else None
                            found.append(known[key])
                out = part.assign(max_ccn=pd.array(found, "Int32"))
                yield out[out["max_ccn"].notna()]

    ship(touches.sparkSession)
    wanted = touches.where(text.is_code_path("path") & ~F.col("path").contains("\n")).select("repo", "sha", "path").distinct()
    return wanted.repartition(parallel, "sha").mapInPandas(run, "repo string, sha string, path string, max_ccn int")


def base_name_of(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def blame_inducing(fixes: DataFrame, parallel: int = 64) -> DataFrame:
    """(fix_sha, path, inducing_sha) from (repo, sha): commits that last changed the lines a fix deletes, by line blame against its parent."""
    import re

    import pandas as pd

    hunk = re.compile(r"^@@ -(\d+)(?:,(\d+))? ")

    def one(repo: str, sha: str):
        path, out = None, set()
        for line in git(repo, "diff", "-U0", "-w", f"{sha}^", sha).splitlines():
            if line.startswith("--- "):
                path = line[6:] if line.startswith("--- a/") else None
            m = hunk.match(line)
            if m and path and (m[2] is None or int(m[2])):
                first, n = int(m[1]), int(m[2] or 1)
                for blamed in git(repo, "blame", "-w", "-l", "-s", "-L", f"{first},{first + n - 1}", f"{sha}^", "--", path).splitlines():
                    code = blamed.split(")", 1)[-1].strip()
                    if code and not code.startswith(("#", "//", "/*", "*")):
                        out.add((sha, path, blamed.split(" ", 1)[0].lstrip("^")))
        return out

    def run(frames):
        for frame in frames:
            rows = set()
            for repo, sha in zip(frame["repo"], frame["sha"], strict=True):
                try:
                    rows |= one(repo, sha)
                except (subprocess.CalledProcessError, UnicodeError):
                    continue  # a root commit, or a fix that git can't compare
            yield pd.DataFrame(sorted(rows), columns=["fix_sha", "path", "inducing_sha"], dtype=object)

    ship(fixes.sparkSession)
    # Only fixes are blamed; they are dealt out before the costly part.
    return fixes.select("repo", "sha").repartition(parallel, "sha").mapInPandas(run, "fix_sha string, path string, inducing_sha string")
