"""One repository from log to payload: what changed, what is known of it, its score and its reach."""

from __future__ import annotations

import json
import os
from datetime import datetime

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..config import Settings
from ..functions import source_code, text
from ..operators import features, graph, history, matching, model, rules
from ..sources import gitlog
from . import narrative, payload
from .storage import cut

#: Files of our own that a change never counts.
OWN = ".churnlens/"
#: What each mode compares, and whether rules about the change as a whole apply.
MODES = {"scan": "changes since the base branch", "diff": "uncommitted changes", "all": "every tracked file"}


def described(mode) -> Column:
    """The text of a mode; null for an unknown one."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in MODES.items() for x in pair)), F.col(mode) if isinstance(mode, str) else mode)


def not_own(files: DataFrame) -> DataFrame:
    """``files`` (path, ...) without our own."""
    return files.where(~F.col("path").startswith(OWN))


def known_paths(tracked: DataFrame, files: DataFrame) -> DataFrame:
    """(path) of the tracked files and of those in scope, once each."""
    return tracked.select("path").unionByName(files.select("path")).distinct()


def _load(spark: SparkSession, kind: str, repo: str, **options) -> DataFrame:
    gitlog.register(spark)
    reader = spark.read.format(kind).option("path", repo)
    for k, v in options.items():
        reader = reader.option(k, v) if v else reader
    return cut(reader.load())


def diffed(lines: DataFrame) -> DataFrame:
    """(path, lines_added, lines_deleted) of numstat lines, at the new names."""
    rows = lines.select(F.inline(text.numstat_lines(F.col("line")))).select(text.split_rename("raw")["new"].alias("path"), F.col("added").alias("lines_added"), F.col("deleted").alias("lines_deleted"))
    return rows.groupBy("path").agg(F.sum("lines_added").alias("lines_added"), F.sum("lines_deleted").alias("lines_deleted"))


def untracked(spark: SparkSession, repo: str) -> DataFrame:
    """New files with their line counts, read where the tasks run; what isn't text counts 0."""
    root = os.path.abspath(repo)

    def run(frames):
        import pandas as pd

        for frame in frames:
            lines = []
            for path in frame["line"]:
                try:
                    with open(os.path.join(root, path), encoding="utf-8") as f:
                        lines.append(len(f.read().splitlines()))
                except (OSError, UnicodeDecodeError):
                    lines.append(0)
            yield pd.DataFrame({"path": frame["line"], "lines_added": lines, "lines_deleted": 0})

    return _load(spark, "gitfiles", repo, untracked="1").select("line").mapInPandas(run, "path string, lines_added long, lines_deleted long")


def changed(spark: SparkSession, repo: str, mode: str, since: str | None = None) -> tuple[DataFrame, dict]:
    """The files in scope and the scope's facts: author, time, base and where history ends."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    zero = F.lit(0).cast("long")
    if mode == "scan":
        ref, base = gitlog.resolve_base(repo, since)
        author, when = gitlog.git(repo, "log", "-1", "--format=%an%x1f%aI", "HEAD").strip().split("\x1f")
        files = diffed(_load(spark, "gitdiff", repo, base=base, head="HEAD"))
        facts = {"author": author or "unknown", "when": when[:19], "base_ref": ref, "base_commit": base, "until": base}
    else:
        try:
            author = gitlog.git(repo, "config", "user.name").strip()
        except Exception:  # noqa: BLE001  nothing configured
            author = "unknown"
        if mode == "diff":
            diff = diffed(_load(spark, "gitdiff", repo, base="HEAD"))
            files = diff.unionByName(untracked(spark, repo).join(diff.select("path"), "path", "left_anti"))
        else:
            files = _load(spark, "gitfiles", repo).select(F.col("line").alias("path"), zero.alias("lines_added"), zero.alias("lines_deleted"))
        facts = {"author": author, "when": datetime.now().isoformat()[:19], "base_ref": None, "base_commit": None, "until": "HEAD"}
    return not_own(files), facts | {"mode": mode, "description": MODES[mode]}


def import_names(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((src, ref), (name, path)) of the files of (path, source), by all registered parsers."""
    references = index = None
    for parser in source_code.PARSERS.values():
        refs, names = parser.references(sources), parser.names(sources)
        references, index = (refs, names) if references is None else (references.unionByName(refs), index.unionByName(names))
    return cut(references), cut(index.distinct())


def import_edges(sources: DataFrame) -> DataFrame:
    """Import edges between the files of (path, source)."""
    return cut(graph.build_edges(*import_names(sources)))


def model_path(repo: str) -> str:
    """Where training leaves a repository's model."""
    return f"file://{os.path.abspath(repo)}/{OWN}model"


def sources_of(spark: SparkSession, repo: str, mode: str, settings: Settings) -> DataFrame:
    """(path, source) of the tracked files that a parser reads: as they lie in the working tree if that is in scope, else of HEAD."""
    if mode == "scan":
        blobs = _load(spark, "gitblob", repo, max_bytes=str(settings.blast.max_bytes))
        found = blobs.select(F.substring_index("line", gitlog.FIELD, 1).alias("path"), F.regexp_replace("line", f"^[^{gitlog.FIELD}]*{gitlog.FIELD}", "").alias("source"))
    else:
        root = "file://" + os.path.abspath(repo)
        tracked = _load(spark, "gitfiles", repo).unionByName(_load(spark, "gitfiles", repo, untracked="1")).select(F.col("line").alias("path")).distinct()
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{','.join(source_code.PARSED)}}}").load(root).where(F.col("length") <= settings.blast.max_bytes)
        at = F.substring(F.regexp_replace("path", "^file:/+", "/"), len(os.path.abspath(repo)) + 2, 1 << 20)
        found = files.select(at.alias("path"), F.call_function("make_valid_utf8", F.col("content").cast("string")).alias("source")).join(tracked, "path", "left_semi")
    readable = cut(found.where(F.substring_index("path", ".", -1).isin(*source_code.PARSED)))
    # The graph's limit: so many files at most, in order of their paths.
    return readable.orderBy("path").limit(settings.blast.max_files)


def scored_by_model(wide: DataFrame, fitted: GBTClassificationModel, trees: model.Trees, whole: bool, settings: Settings) -> dict:
    """Score, band, reasons, files and recommendation by a model.

    A file's score is that of a change of this file alone; without ``whole`` the worst file's is the headline.
    """
    single = cut(features.feature_vector(wide.withColumn("sha", F.col("path"))))
    probable = model.as_scores(model.predict(single, fitted), settings.weights).select(F.col("sha").alias("path"), "probability", "score", "band")
    top = model.contributions(single, trees, most=1).select(F.col("sha").alias("path"), F.struct(*_MODEL_REASON).alias("top"))
    listed = wide.select("path", "lines_added", "lines_deleted").join(probable, "path").join(top, "path", "left").orderBy(F.desc("probability"), "path").collect()
    vector = features.feature_vector(wide) if whole else single.where(F.col("sha") == listed[0]["path"])
    head = model.as_scores(model.predict(vector, fitted), settings.weights).first()
    reasons = [_told(r) for r in model.contributions(vector, trees, most=settings.training.top_contributions).orderBy("place").select(*_MODEL_REASON).collect()]
    hints = list(dict.fromkeys(rules.HINTS[r["rule"]] for r in reasons if r["rule"] in rules.HINTS))[:2]
    advice = rules.HEADLINES[head["band"]] + (f" Suggested: {'; '.join(hints)}." if hints else "")
    files = [
        {"path": r["path"], "score": r["score"], "band": r["band"], "lines_added": r["lines_added"], "lines_deleted": r["lines_deleted"], "reasons": [_told(r["top"], r["path"])] if r["top"] else []}
        for r in listed
    ]
    # A change of one file has no ranking.
    return {"scoring_method": "model", "score": head["score"], "band": head["band"], "recommendation": advice, "reasons": reasons, "files": files if len(files) > 1 or not whole else []}


_MODEL_REASON = ("feature", "value", "impact")


def _told(reason, path: str | None = None) -> dict:
    """A contribution as a reason: points are hundredths of log-odds."""
    return {
        "rule": f"model:{reason['feature']}", "label": features.FEATURES[reason["feature"]], "points": round(reason["impact"] * 100),
        "detail": f"value {reason['value']:g}; log-odds {reason['impact']:+.3f}", "path": path,
    }


def analyse(spark: SparkSession, repo: str, mode: str = "scan", since: str | None = None, settings: Settings = Settings(), saved: str | None = None) -> dict:
    """The payload of the repository's present change, scored by its model (``saved``) if there is one that fits, else by rules."""
    files, scope = changed(spark, repo, mode, since)
    files = cut(files)
    records = gitlog.read_records(spark, repo, until=scope["until"])
    commits, touches = gitlog.followed(records)
    touches = cut(touches)
    stats = gitlog.log_stats(records).agg(F.sum("skipped").alias("skipped")).first()
    trees, facts, warnings = None, None, []
    found = model.load(spark, saved or model_path(repo))
    if found is not None and found[0] is None:
        warnings.append("the saved model was fitted on other features and is not used; train it again")
    elif found is not None:
        trees, facts = model.trees_of(spark, found[0]), found[1]
    known = history.file_history(touches).select("path", F.col("total_commits").alias("prior_commits"), F.col("bugfix_commits").alias("prior_fixes"))
    mine = history.author_history(touches.where(F.col("author") == scope["author"])).select("path", F.col("author_commits").alias("prior_by_author"))
    tracked = known_paths(_load(spark, "gitfiles", repo).withColumnRenamed("line", "path"), files)
    sources = sources_of(spark, repo, mode, settings)
    ccn = source_code.complexity(sources).select("path", "max_ccn")
    zero = F.lit(0).cast("long")
    wide = files.join(known, "path", "left").join(mine, "path", "left").join(ccn, "path", "left").withColumns(
        {"prior_commits": F.coalesce("prior_commits", zero), "prior_fixes": F.coalesce("prior_fixes", zero), "prior_by_author": F.coalesce("prior_by_author", zero),
         "sha": F.lit("change"), "author": F.lit(scope["author"]), "when_local": F.lit(scope["when"]).cast("timestamp_ntz")}
    )
    wide = matching.with_tests(wide, tracked)
    limits = history.calibrated(history.distribution(history.file_history(touches), settings.distribution), settings.weights, settings.distribution)
    scored = cut(rules.score_files(wide.crossJoin(F.broadcast(limits)), settings.weights))
    change = rules.score_changes(scored, settings.weights, change_rules=mode != "all")
    known_scope = {k: scope[k] for k in ("mode", "description", "author", "base_ref", "base_commit")} | {
        "repo": repo, "analyzed_at": scope["when"], "commits_walked": commits.count(), "commits_skipped": int(stats["skipped"] or 0), "files_analyzed": 0, "model": None,
        "relative_thresholds": limits.first()["relative_thresholds"] if trees is None else False,
    }
    made = payload.payloads(change, mode=mode).collect()
    if not made:
        return payload.nothing(known_scope, warnings)
    doc = json.loads(made[0]["payload"])
    doc["scope"] = known_scope | {"files_analyzed": doc["scope"]["files_analyzed"]}
    doc["warnings"] = warnings
    if trees is not None:
        doc |= scored_by_model(wide, found[0], trees, mode != "all", settings)
        doc["scope"]["model"] = {k: facts.get(k) for k in ("trained_at", "rows", "positives", "commits_considered")}
    if settings.blast.enabled:
        edges = import_edges(sources)
        risks = {f["path"]: f["score"] for f in doc["files"]} if trees is not None else None
        roots = scored.select(F.col("path").alias("root"), "score")
        if risks:
            roots = spark.createDataFrame(list(risks.items()), "root string, score int")
        riskiest = [F.desc("score"), "root"]
        per = graph.impact(edges, roots.orderBy(*riskiest).limit(settings.blast.analyzed).select("root"), settings.blast).collect()
        total = graph.rollup(edges, roots, *riskiest, config=settings.blast).first().asDict()
        lists = graph.listed(edges, roots, *riskiest, config=settings.blast)
        skipped = graph.reference_counts(*import_names(sources)).first().asDict()
        doc["blast_radius"] = {"analyzed": True} | total | lists | {
            "max_depth": settings.blast.max_depth, "listed_limit": settings.blast.listed, "depth_capped": any(r["depth_capped"] for r in per), "hubs": sorted(r["root"] for r in per if r["is_hub"]),
            "cycle_files": sorted(r["root"] for r in per if r["in_cycle"]), "graph": {"files": sources.count(), "edges": edges.count(), "parsers": sorted(source_code.PARSERS)} | skipped,
            "per_file": [{"path": r["root"]} | {k: v for k, v in r.asDict().items() if k != "root"} for r in sorted(per, key=lambda r: (-(r["direct_count"] + r["transitive_count"]), r["root"]))],
        }
    return doc


def training_rows(spark: SparkSession, repo: str, settings: Settings = Settings()) -> DataFrame:
    """Leak-free features and labels of a repository's commits; labels by line blame of the fixes."""
    commits, touches = gitlog.read_log(spark, repo, max_commits=str(settings.training.max_commits))
    touches = cut(touches)
    running = history.running_history(touches).join(gitlog.complexity_then(touches), ["repo", "sha", "path"], "left")
    labels = history.labelled(commits, gitlog.blame_inducing(commits.where("is_bugfix"))).select("sha", "seq", "label")
    return features.feature_vector(running).join(labels, "sha")


def main(arguments: list[str] | None = None) -> int:
    """scan, diff, all, train, evaluate or report on a repository; prints JSON (report: text), or the version. Ends with 2 on a repository's and 3 on a model's error."""
    import argparse
    import subprocess
    import sys

    parser = argparse.ArgumentParser(prog="churnlens")
    parser.add_argument("command", choices=[*MODES, "train", "evaluate", "report", "version"])
    parser.add_argument("repo", nargs="?", default=".")
    parser.add_argument("--since")
    parser.add_argument("--model", help="where the model is saved")
    options = parser.parse_args(arguments)
    if options.command == "version":
        print(__version__)
        return 0
    spark, settings = SparkSession.builder.getOrCreate(), Settings.from_env()
    try:
        if options.command in MODES:
            print(json.dumps(analyse(spark, options.repo, options.command, options.since, settings, options.model), ensure_ascii=False))
        elif options.command == "report":
            print(narrative.report(analyse(spark, options.repo, "scan", options.since, settings, options.model)))
        elif options.command == "evaluate":
            print(json.dumps(model.evaluate(training_rows(spark, options.repo, settings), settings.training)))
        else:
            rows = cut(training_rows(spark, options.repo, settings))
            fitted, _ = model.train(rows, settings.training)
            total = rows.count()
            facts = {"rows": total, "positives": rows.where("label = 1").count(), "commits_considered": total, "trained_at": datetime.now().isoformat()[:19]}
            model.save(fitted, options.model or model_path(options.repo), facts)
            if not options.model:  # results of our own are no part of the repository
                with open(os.path.join(options.repo, OWN, ".gitignore"), "w", encoding="utf-8") as f:
                    f.write("*\n")
    except (subprocess.CalledProcessError, OSError) as e:
        print(e, file=sys.stderr)
        return 2
    except ValueError as e:
        print(e, file=sys.stderr)
        return 3
    return 0
