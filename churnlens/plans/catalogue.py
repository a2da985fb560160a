"""All queries by name over the order tables, with the same results as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..operators import features, graph, history, matching, metrics, renames, rules
from ..sources import adapter
from . import sql
from .storage import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


@query(sql.COMMITS + "SELECT sha, subject, is_bugfix FROM commits")
def bugfix_detection(spark, sf):
    return adapter.commits(spark, sf).select("sha", "subject", "is_bugfix")


@query(sql.COMMITS + "SELECT subject, count(*) AS n, CAST(sum(CAST(is_bugfix AS INT)) AS BIGINT) AS fixes FROM commits GROUP BY subject")
def subject_counts(spark, sf):
    return adapter.commits(spark, sf).groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_bugfix").cast("long")).alias("fixes"))


@query(sql.HISTORY + "SELECT * FROM history")
def file_history(spark, sf):
    return history.file_history(adapter.touches(spark, sf))


@query(sql.TOUCHES + """SELECT path, author, count(*) AS author_commits, CAST(sum(count(*)) OVER (PARTITION BY path) AS BIGINT) AS total_commits,
  round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY path), 9) AS ownership FROM touches GROUP BY path, author""")
def author_ownership(spark, sf):
    return history.ownership(adapter.touches(spark, sf)).withColumn("ownership", F.round("ownership", 9))


@query(sql.TOUCHES + """SELECT path, string_agg(author || ':' || CAST(n AS VARCHAR), ',' ORDER BY author) AS authors
  FROM (SELECT path, author, count(*) AS n FROM touches GROUP BY path, author) GROUP BY path""")
def commits_per_author_map(spark, sf):
    per = history.commits_per_author(adapter.touches(spark, sf))
    entries = F.transform(F.map_entries("commits_per_author"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return per.select("path", F.array_join(entries, ",").alias("authors"))


@query(sql.DISTRIBUTION + "SELECT * FROM distribution")
def distribution_percentiles(spark, sf):
    return history.distribution(history.file_history(adapter.touches(spark, sf)))


@query(sql.LIMITS + "SELECT * FROM limits")
def calibrated_thresholds(spark, sf):
    return history.calibrated(history.distribution(history.file_history(adapter.touches(spark, sf))))


@query(sql.PATHS + "SELECT path, is_test, is_code, folder FROM paths")
def classify_paths(spark, sf):
    return adapter.touches(spark, sf).select("path").distinct().select("path", text.is_test_path("path").alias("is_test"), text.is_code_path("path").alias("is_code"), text.folder("path").alias("folder"))


@query(sql.PATHS + "SELECT folder, count(*) AS n FROM paths GROUP BY folder")
def folder_of_path(spark, sf):
    return adapter.touches(spark, sf).select("path").distinct().groupBy(text.folder("path").alias("folder")).agg(F.count(F.lit(1)).alias("n"))


@query(sql.TESTS + "SELECT path, test_path FROM tests")
def test_match(spark, sf):
    paths = adapter.touches(spark, sf).select("path").distinct()
    return matching.matched_tests(paths, paths)


@query(sql.TESTS + "SELECT DISTINCT f.sha, f.path FROM touches f JOIN tests t USING (path) JOIN touches g ON g.sha = f.sha AND g.path = t.test_path")
def tests_changed_semi(spark, sf):
    touched = adapter.touches(spark, sf).select("sha", "path")
    paths = touched.select("path").distinct()
    return matching.with_tests(touched.distinct(), paths).where("tests_changed").select("sha", "path")


@query(sql.TOUCHES + "SELECT DISTINCT path FROM touches WHERE path NOT IN (SELECT path FROM touches WHERE author IN ('author_1', 'author_2', 'author_3'))")
def untracked_anti(spark, sf):
    touched = adapter.touches(spark, sf)
    return touched.select("path").distinct().join(touched.where("author IN ('author_1', 'author_2', 'author_3')").select("path"), "path", "left_anti")


@query(sql.TOUCHES + """SELECT path, CAST(sum(lines_added) AS BIGINT) AS lines_added, CAST(sum(lines_deleted) AS BIGINT) AS lines_deleted FROM touches
  WHERE seq > (SELECT quantile_disc(seq, 0.9) FROM commits) GROUP BY path
  UNION ALL SELECT DISTINCT 'untracked/' || CAST(p_partkey AS VARCHAR), CAST(p_size AS BIGINT), CAST(0 AS BIGINT) FROM part""")
def working_tree(spark, sf):
    """Diffed files and untracked ones, each path once."""
    base = adapter.commits(spark, sf).agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY seq)").alias("base"))
    diff = adapter.touches(spark, sf).join(F.broadcast(base), F.col("seq") > F.col("base")).groupBy("path").agg(F.sum("lines_added").alias("lines_added"), F.sum("lines_deleted").alias("lines_deleted"))
    new = adapter.table(spark, sf, "part").select(F.concat(F.lit("untracked/"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_size").cast("long").alias("lines_added"), F.lit(0).cast("long").alias("lines_deleted"))
    return diff.unionByName(new.join(diff.select("path"), "path", "left_anti"))


_RUN = ["sha", "path", "lines_added", "lines_deleted", "prior_commits", "prior_fixes", "prior_by_author"]


@query(sql.RUNNING + "SELECT sha, path, lines_added, lines_deleted, prior_commits, prior_fixes FROM running")
def running_history(spark, sf):
    return history.running_history(adapter.touches(spark, sf)).select(*_RUN[:-1])


@query(sql.RUNNING + "SELECT sha, path, author, prior_by_author FROM running")
def running_author_history(spark, sf):
    return history.running_history(adapter.touches(spark, sf)).select("sha", "path", "author", "prior_by_author")


def _running(spark, sf):
    return history.running_history(adapter.touches(spark, sf)).join(adapter.complexity(spark, sf), "l_partkey", "left")


@query(sql.FEATURES + "SELECT * FROM features")
def feature_vector(spark, sf):
    # Averages of fractions depend on the order of summation in their last digits.
    return features.feature_vector(_running(spark, sf)).withColumns({c: F.round(c, 9) for c in ("min_author_ownership", "mean_author_ownership", "mean_complexity", "mean_file_commits", "mean_file_bugfixes")})


@query(sql.COMMITS + "SELECT sha, CAST(hour(when_local) AS INT) AS hour_of_day, CAST(isodow(when_local) - 1 AS INT) AS day_of_week, CASE WHEN isodow(when_local) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM commits")
def timing_features(spark, sf):
    return features.timing(adapter.commits(spark, sf))


def changed_files(spark, sf) -> DataFrame:
    """Every file of every commit, with what was known before it and the repository's thresholds."""
    # Written once: history, paths, thresholds and tests all read it.
    touched = written(adapter.touches(spark, sf).select("sha", "path", "seq", "author", "is_bugfix", "when_local", "l_partkey", "lines_added", "lines_deleted"), "touches")
    run = history.running_history(touched)
    per = run.groupBy("sha", "path", "author", "when_local", "l_partkey").agg(
        F.sum("lines_added").alias("lines_added"), F.sum("lines_deleted").alias("lines_deleted"), F.max("prior_commits").alias("prior_commits"), F.max("prior_fixes").alias("prior_fixes"), F.max("prior_by_author").alias("prior_by_author")
    )
    per = per.join(adapter.complexity(spark, sf), "l_partkey", "left")
    wide = matching.with_tests(per, touched.select("path").distinct())
    # One row of thresholds.
    return wide.crossJoin(F.broadcast(history.calibrated(history.distribution(history.file_history(touched)))))


def scored_files(spark, sf) -> DataFrame:
    return rules.score_files(changed_files(spark, sf))


def _rule(rule_names: tuple[str, ...]):
    names = ", ".join(f"'{n}'" for n in rule_names)

    def run(spark, sf):
        fired = scored_files(spark, sf).select("sha", F.explode("reasons").alias("r")).select("sha", "r.path", "r.rule", "r.points", "r.detail")
        return fired.where(F.col("rule").isin(*rule_names))

    return run, sql.REASONS + f"SELECT sha, path, rule, points, detail FROM file_reasons WHERE rule IN ({names})"


for _name, _rules in {
    "rule_large_edit": ("large_edit",), "rule_hot_file": ("hot_file",), "rule_churn": ("churn",), "rule_tests": ("missing_tests", "stale_tests"),
    "rule_familiarity": ("author_new_to_file", "low_ownership"), "rule_complexity": ("high_complexity",),
}.items():
    QUERIES[_name], ORACLES[_name] = _rule(_rules)


@query(sql.FILE_SCORES + "SELECT sha, path, score, band, reasons FROM file_scores")
def file_scores(spark, sf):
    listed = F.array_join(F.transform("reasons", lambda r: F.concat(r["rule"], F.lit(":"), r["points"].cast("string"))), ",")
    return scored_files(spark, sf).select("sha", "path", "score", "band", listed.alias("reasons"))


@query(sql.FILE_SCORES + "SELECT band, count(*) AS n, min(score) AS lowest, max(score) AS highest FROM file_scores GROUP BY band")
def bands(spark, sf):
    return scored_files(spark, sf).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("lowest"), F.max("score").alias("highest"))


@query(sql.FILE_SCORES + "SELECT sha, path, score, row_number() OVER (PARTITION BY sha ORDER BY score DESC, path) AS rank FROM file_scores")
def ranked_files(spark, sf):
    return rules.ranked(scored_files(spark, sf)).select("sha", "path", "score", F.col("rank").cast("long").alias("rank"))


def _changes(spark, sf):
    return rules.score_changes(scored_files(spark, sf))


def _context(rule_names):
    names = ", ".join(f"'{n}'" for n in rule_names)

    def run(spark, sf):
        fired = _changes(spark, sf).select("sha", F.explode("reasons").alias("r")).select("sha", "r.rule", "r.points", "r.detail")
        return fired.where(F.col("rule").isin(*rule_names))

    return run, sql.CHANGE_SCORES + f"SELECT sha, rule, points, detail FROM context WHERE rule IN ({names})"


QUERIES["rule_broad_change"], ORACLES["rule_broad_change"] = _context(("broad_change",))
QUERIES["rule_timing"], ORACLES["rule_timing"] = _context(("weekend_deploy", "late_night_deploy"))


@query(sql.CHANGE_SCORES + "SELECT sha, score, band, n_files, n_lines FROM change_scores")
def change_scores(spark, sf):
    return _changes(spark, sf).select("sha", "score", "band", "n_files", "n_lines")


@query(sql.CHANGE_SCORES + "SELECT sha, reasons FROM change_scores")
def top_reasons(spark, sf):
    top = F.transform("reasons", lambda r: F.concat(r["points"].cast("string"), F.lit(" "), r["rule"], F.lit(" "), F.coalesce(r["path"], F.lit("-")), F.lit(" "), r["detail"]))
    return _changes(spark, sf).select("sha", F.array_join(F.slice(top, 1, 5), " | ").alias("reasons"))


@query(sql.RECOMMENDATION)
def recommendation(spark, sf):
    return _changes(spark, sf).select("sha", "recommendation")


@query("""SELECT id, label, row_number() OVER (ORDER BY id) <= greatest(1, least(floor((SELECT count(*) FROM scored) * 0.75), (SELECT count(*) FROM scored) - 1)) AS is_train
  FROM (SELECT d.doc_id AS id, toxic AS label FROM labels JOIN documents d USING (doc_id)) scored""".replace("FROM scored)", "FROM labels JOIN documents USING (doc_id))"))
def time_split(spark, sf):
    return metrics.time_split(adapter.scored(spark, sf), 0.75, "seq", "id").select("id", "label", "is_train")


@query(sql.SCORED + """SELECT round((sum(r * label) - sum(label) * (sum(label) + 1) / 2.0) / (CAST(sum(label) AS DOUBLE) * sum(1 - label)), 12) AS roc_auc
  FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM scored)""")
def roc_auc(spark, sf):
    return metrics.roc_auc(adapter.scored(spark, sf)).select(F.round("roc_auc", 12).alias("roc_auc"))


@query(sql.SCORED + """, per AS (SELECT score, count(*) AS n, sum(label) AS pos FROM scored GROUP BY score),
  run AS (SELECT pos, CAST(sum(pos) OVER w AS DOUBLE) AS tp, CAST(sum(n) OVER w AS DOUBLE) AS seen, CAST(sum(pos) OVER () AS DOUBLE) AS total FROM per WINDOW w AS (ORDER BY score DESC))
  SELECT round(sum(pos / total * (tp / seen)), 12) AS pr_auc FROM run""")
def pr_auc(spark, sf):
    return metrics.pr_auc(adapter.scored(spark, sf)).select(F.round("pr_auc", 12).alias("pr_auc"))


@query(sql.SCORED + "SELECT greatest(1.0::DOUBLE, CAST(count(*) - sum(label) AS DOUBLE) / CAST(sum(label) AS DOUBLE)) AS class_weight FROM scored")
def class_weight(spark, sf):
    return metrics.class_weight(adapter.scored(spark, sf))


@query(sql.SCORED + "SELECT count(*) AS rows, CAST(sum(label) AS BIGINT) AS positives, CAST(sum(label) AS DOUBLE) / count(*) AS base_rate FROM scored")
def base_rate(spark, sf):
    return metrics.base_rate(adapter.scored(spark, sf))


@query(sql.EDGES + "SELECT src, dst FROM edges")
def edges(spark, sf):
    return adapter.edges(spark, sf)


def _graph(spark, sf):
    """(edges, roots): the edges written once, since the loops read them every round; every file that is imported is a root."""
    edges = written(adapter.edges(spark, sf), "edges")
    return edges, edges.select(F.col("dst").alias("root")).distinct()


@query(sql.REACHED + "SELECT root, node, depth FROM reached")
def reverse_bfs(spark, sf):
    return graph.dependents(*_graph(spark, sf))


def _joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


@query(sql.IMPACT + "SELECT * FROM impact")
def impact_per_file(spark, sf):
    return graph.impact(*_graph(spark, sf)).select("root", "direct_count", "transitive_count", _joined("direct"), _joined("transitive"), "in_cycle", "depth_capped", "is_hub")


@query(sql.rolled_up(40))
def impact_rollup(spark, sf):
    return graph.rollup(*_graph(spark, sf), "root")


@query(sql.EDGES + ", reach(src, dst) AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src) SELECT DISTINCT src AS node FROM reach WHERE src = dst")
def cycles(spark, sf):
    return graph.cyclic_nodes(_graph(spark, sf)[0])


@query(sql.EDGES + "SELECT dst AS path, count(*) AS importers FROM edges GROUP BY dst HAVING count(*) >= 20")
def hubs(spark, sf):
    return adapter.edges(spark, sf).groupBy(F.col("dst").alias("path")).agg(F.count(F.lit(1)).alias("importers")).where("importers >= 20")


def _references(spark, sf):
    """(src, ref) and (name, path) of a made-up package tree."""
    part = adapter.table(spark, sf, "part")
    ref = F.expr("CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN concat('pkg', p_partkey % 25, '.*') WHEN 1 THEN concat('pkg', p_partkey % 25, '.m', p_partkey % 40, '.name') WHEN 2 THEN concat('pkg', p_partkey % 25, '.m', p_partkey % 40) ELSE 'os.path' END")
    index = part.select(F.expr("concat('pkg', p_partkey % 25, '.m', p_partkey % 50)").alias("name"), F.expr("concat('pkg', p_partkey % 25, '/m', p_partkey % 50, if(p_partkey % 11 = 0, '/__init__.py', '.py'))").alias("path"))
    index = index.unionByName(part.select(F.expr("concat('pkg', p_partkey % 25)").alias("name"), F.expr("concat('pkg', p_partkey % 25, '/__init__.py')").alias("path")))
    return part.select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("src"), ref.alias("ref")), index.distinct()


@query(sql.REFERENCES + "SELECT src, ref, path, count(*) OVER (PARTITION BY src, ref) > 1 AS ambiguous FROM resolved")
def longest_prefix_resolve(spark, sf):
    return graph.resolve_prefix(*_references(spark, sf))


@query(sql.REFERENCES + "SELECT DISTINCT r.src, r.ref, i.path FROM refs r JOIN index_ i ON r.ref LIKE '%.*' AND regexp_extract(i.name, '^(.*)\\.', 1) = r.ref[1:length(r.ref) - 2] AND i.name LIKE '%.%'")
def wildcard_resolve(spark, sf):
    return graph.resolve_wildcard(*_references(spark, sf))


@query(sql.TOUCHES + """SELECT DISTINCT f.sha AS fix_sha, f.path, arg_max(g.sha, g.seq) AS inducing_sha
  FROM touches f JOIN touches g ON g.path = f.path AND g.seq < f.seq WHERE f.is_bugfix GROUP BY f.sha, f.path""")
def szz_asof_labels(spark, sf):
    return history.inducing(adapter.touches(spark, sf))


@query(sql.TOUCHES + """, bad AS (SELECT DISTINCT arg_max(g.sha, g.seq) AS sha FROM touches f JOIN touches g ON g.path = f.path AND g.seq < f.seq WHERE f.is_bugfix GROUP BY f.sha, f.path)
  SELECT c.sha, CASE WHEN b.sha IS NULL THEN 0 ELSE 1 END AS label FROM commits c LEFT JOIN bad b USING (sha)""")
def labelled_commits(spark, sf):
    return history.labelled(adapter.commits(spark, sf), history.inducing(adapter.touches(spark, sf))).select("sha", "label")


@query(sql.TOUCHES + "SELECT sha FROM commits WHERE is_bugfix INTERSECT SELECT sha FROM touches WHERE path LIKE 'tests/%'")
def inducing_intersect(spark, sf):
    return adapter.commits(spark, sf).where("is_bugfix").select("sha").intersect(adapter.touches(spark, sf).where(F.col("path").startswith("tests/")).select("sha"))


@query("""SELECT k * 3 + shift AS pos, 'r' || k || '/' || old || '.py' AS path, 'r' || k || '/' || CASE WHEN shift < 0 OR (shift = 500 AND old = 'c') THEN old ELSE 'b' END || '.py' AS canonical
  FROM (SELECT p_partkey AS k FROM part), unnest([-1, 500, 1500, 2500]) AS t(shift), unnest(['a', 'b', 'c']) AS u(old)""")
def rename_asof(spark, sf):
    """Iterated as-of lookups before, between and after a part's renames; the SQL states the expected names, and the tests walk the log."""
    part = adapter.table(spark, sf, "part").withColumn("at", F.explode(F.array(*map(F.lit, (-1, 500, 1500, 2500)))))
    named = part.select((F.col("p_partkey") * 3 + F.col("at")).alias("pos"), F.explode(F.array(*(F.concat(F.lit("r"), F.col("p_partkey").cast("string"), F.lit(s)) for s in ("/a.py", "/b.py", "/c.py")))).alias("path"))
    return renames.canonical_paths(named, adapter.renames(spark, sf))


@query("""SELECT raw, CASE WHEN raw LIKE '%{%' THEN regexp_replace(replace(regexp_extract(raw, '^(.*?)[{]', 1) || trim(regexp_extract(raw, '[{](.*?)=>', 1)) || regexp_extract(raw, '[}](.*)$', 1), '//', '/'), '^/', '') WHEN raw LIKE '%=>%' THEN trim(regexp_extract(raw, '^(.*?)=>', 1)) ELSE raw END AS old_path,
  CASE WHEN raw LIKE '%{%' THEN regexp_replace(replace(regexp_extract(raw, '^(.*?)[{]', 1) || trim(regexp_extract(raw, '=>(.*?)[}]', 1)) || regexp_extract(raw, '[}](.*)$', 1), '//', '/'), '^/', '') WHEN raw LIKE '%=>%' THEN trim(regexp_extract(raw, '=>(.*)$', 1)) ELSE raw END AS new_path
  FROM (SELECT CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN 'src/m' || p_partkey || '.py' WHEN 1 THEN 'm' || p_partkey || '.py => n' || p_partkey || '.py' WHEN 2 THEN 'app/{old' || p_partkey || ' => new' || p_partkey || '}/core.py' WHEN 3 THEN '{ => src}/m' || p_partkey || '.py' ELSE 'a/{b' || p_partkey || ' => }/c.py' END AS raw FROM part)""")
def rename_notation(spark, sf):
    raw = """CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN concat('src/m', p_partkey, '.py') WHEN 1 THEN concat('m', p_partkey, '.py => n', p_partkey, '.py')
      WHEN 2 THEN concat('app/{old', p_partkey, ' => new', p_partkey, '}/core.py') WHEN 3 THEN concat('{ => src}/m', p_partkey, '.py') ELSE concat('a/{b', p_partkey, ' => }/c.py') END"""
    rows = adapter.table(spark, sf, "part").select(F.expr(raw).alias("raw"))
    return rows.withColumn("r", text.split_rename("raw")).select("raw", F.col("r.old").alias("old_path"), F.col("r.new").alias("new_path"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import extras, log_queries  # noqa: F401  the latter adds its queries to QUERIES

    return QUERIES | extras.queries()


def oracle_sql() -> dict[str, str]:
    from . import log_queries  # noqa: F401  adds its SQL to ORACLES

    return dict(ORACLES)
