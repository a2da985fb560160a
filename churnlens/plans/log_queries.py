"""Queries over raw log text, source files and the import index, all with SQL; the inputs are made from the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Training
from ..functions import source_code, text
from ..operators import graph, history, metrics
from ..sources import adapter, gitlog
from . import analysis, sql
from .catalogue import _references, query
from .storage import written

# ---- raw logs: one record per order, newest first within one of seven repositories ----


def _records(spark, sf):
    """(repo, pos, line): log records, some of which are cut short, have an unreadable date or a corrupt offset."""
    number = F.expr("CASE WHEN l_discount = 0 THEN '-' ELSE cast(cast(l_quantity AS int) AS string) END")
    raw = F.expr("if(l_linenumber = 3, concat('old/{m', l_partkey, ' => n', l_partkey, '}.py'), concat('pkg', l_partkey % 25, '/m', l_partkey, '.py'))")
    lines = adapter.table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.concat_ws("\t", number, F.col("l_linenumber").cast("string"), raw).alias("t")).alias("x"))
    bodies = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]), "\n").alias("body"))
    stamp = F.date_format("when_local", "yyyy-MM-dd'T'HH:mm:ss")
    offset = F.expr("CASE WHEN o_orderkey % 29 = 0 THEN '+99:99' WHEN o_orderkey % 2 = 0 THEN '+02:00' ELSE '-05:30' END")
    when = F.when(F.col("o_orderkey") % 17 == 0, "no date").otherwise(F.concat(stamp, offset))
    author = F.when(F.col("o_orderkey") % 23 == 0, "").otherwise(F.col("author"))
    header = F.when(F.col("o_orderkey") % 19 == 0, F.concat_ws(gitlog.FIELD, "sha", author)).otherwise(F.concat_ws(gitlog.FIELD, "sha", author, when, "subject"))
    repo, pos = F.concat(F.lit("repo"), (F.col("o_orderkey") % 7).cast("string")), F.lit(1_000_000_000) - F.col("o_orderkey")
    rows = adapter.commits(spark, sf).join(bodies, "o_orderkey", "left")
    return rows.select(repo.alias("repo"), pos.alias("pos"), F.concat(header, F.lit("\n\n"), F.coalesce("body", F.lit("")), F.lit("\n")).alias("line"))


_LOG = sql.COMMITS + """, readable AS (SELECT *, 'repo' || (o_orderkey % 7) AS repo, CASE WHEN o_orderkey % 23 = 0 THEN 'unknown' ELSE author END AS who FROM commits WHERE o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0),
oldest AS (SELECT repo, min(o_orderkey) AS first FROM readable GROUP BY repo) """


@query(_LOG + """SELECT repo, sha, who AS author, when_local, CAST(epoch(when_local) AS BIGINT) - CASE WHEN o_orderkey % 29 = 0 THEN 0 WHEN o_orderkey % 2 = 0 THEN 7200 ELSE -19800 END AS instant,
  subject, is_bugfix, o_orderkey - first AS seq FROM readable JOIN oldest USING (repo)""")
def log_commits(spark, sf):
    return gitlog.parse_log(_records(spark, sf))[0].select("repo", "sha", "author", "when_local", F.unix_timestamp("when_ts").alias("instant"), "subject", "is_bugfix", "seq")


@query(_LOG + """SELECT repo, sha, o_orderkey - first AS seq, CASE WHEN l_linenumber = 3 THEN 'old/n' || l_partkey || '.py' ELSE 'pkg' || (l_partkey % 25) || '/m' || l_partkey || '.py' END AS path,
  CASE WHEN l_linenumber = 3 THEN 'old/m' || l_partkey || '.py' END AS old_path, CASE WHEN l_discount = 0 THEN 0 ELSE CAST(floor(l_quantity) AS INT) END AS lines_added, l_linenumber AS lines_deleted
  FROM readable JOIN oldest USING (repo) JOIN lineitem ON l_orderkey = o_orderkey""")
def log_touches(spark, sf):
    return gitlog.parse_log(_records(spark, sf))[1].select("repo", "sha", "seq", "path", "old_path", "lines_added", "lines_deleted")


@query("""SELECT 'repo' || (o_orderkey % 7) AS repo, count(*) AS records, count(*) FILTER (o_orderkey % 17 = 0 OR o_orderkey % 19 = 0) AS skipped, count(*) >= 250 AS truncated
  FROM orders GROUP BY o_orderkey % 7""")
def log_statistics(spark, sf):
    return gitlog.log_stats(_records(spark, sf), max_commits=250)


@query(sql.TOUCHES + """, lines AS (SELECT CASE CAST(l_partkey % 4 AS INT) WHEN 0 THEN 'old/n' || l_partkey || '.py' ELSE 'src/m' || l_partkey || '.py' END AS path, l_linenumber, l_discount, l_quantity FROM lineitem)
  SELECT path, CAST(sum(CASE WHEN l_discount = 0 THEN 0 ELSE floor(l_quantity) END) AS BIGINT) AS lines_added, CAST(sum(l_linenumber) AS BIGINT) AS lines_deleted FROM lines GROUP BY path""")
def diff_files(spark, sf):
    """Numstat lines of a comparison, at the new names."""
    line = """concat_ws('\t', CASE WHEN l_discount = 0 THEN '-' ELSE cast(cast(l_quantity AS int) AS string) END, l_linenumber,
      CASE CAST(l_partkey % 4 AS INT) WHEN 0 THEN concat('old/m', l_partkey, '.py => old/n', l_partkey, '.py') ELSE concat('src/m', l_partkey, '.py') END)"""
    return analysis.diffed(adapter.table(spark, sf, "lineitem").select(F.expr(line).alias("line")))


@query(sql.TOUCHES + """, bad AS (SELECT DISTINCT arg_max(g.sha, g.seq) AS sha FROM touches f JOIN touches g ON g.path = f.path AND g.seq < f.seq WHERE f.is_bugfix GROUP BY f.sha, f.path)
  SELECT count(*) AS commits, count(*) FILTER (is_bugfix) AS fixes, (SELECT count(*) FROM bad) AS inducing, (SELECT count(*) FROM bad JOIN commits USING (sha)) AS positives FROM commits""")
def mining_summary(spark, sf):
    touched = written(adapter.touches(spark, sf).select("sha", "path", "seq", "is_bugfix"), "touches")
    return history.mining_summary(adapter.commits(spark, sf), history.inducing(touched))


_FRACTIONS = (Training.train_fraction, Training.holdout_fraction)


@query(sql.SCORED.replace("SELECT toxic", "SELECT doc_id AS id, toxic") + """, outer_ AS (SELECT *, row_number() OVER (ORDER BY id) AS n, count(*) OVER () AS total FROM scored),
  fitted AS (SELECT *, row_number() OVER (ORDER BY id) AS m, count(*) OVER () AS part FROM outer_ WHERE n <= greatest(1, least(floor(total * {0}::DOUBLE), total - 1)))
  SELECT id, m <= greatest(1, least(floor(part * {1}::DOUBLE), part - 1)) AS is_fitted FROM fitted""".format(*_FRACTIONS))
def holdout_cut(spark, sf):
    """The newest slice of the training rows, which early stopping looks at."""
    trained = metrics.time_split(adapter.scored(spark, sf), _FRACTIONS[0], "seq", "id").where("is_train").drop("is_train")
    return metrics.time_split(trained, _FRACTIONS[1], "seq", "id").select("id", F.col("is_train").alias("is_fitted"))


# ---- source files, one per part ----


def _paths(spark, sf):
    path = """CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN concat('a/pkg', p_partkey % 25, '/m', p_partkey, '.py') WHEN 1 THEN concat('a/pkg', p_partkey, '/__init__.py') WHEN 2 THEN concat('top', p_partkey, '.pyi')
      WHEN 3 THEN concat('src/K', p_partkey, '.java') WHEN 4 THEN concat('.churnlens/model/', p_partkey) ELSE concat('docs/d', p_partkey, '.md') END"""
    return adapter.table(spark, sf, "part").select(F.expr(path).alias("path"))


_PATHS = """WITH paths AS (SELECT p_partkey AS k, CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN 'a/pkg' || (p_partkey % 25) || '/m' || p_partkey || '.py' WHEN 1 THEN 'a/pkg' || p_partkey || '/__init__.py' WHEN 2 THEN 'top' || p_partkey || '.pyi'
  WHEN 3 THEN 'src/K' || p_partkey || '.java' WHEN 4 THEN '.churnlens/model/' || p_partkey ELSE 'docs/d' || p_partkey || '.md' END AS path FROM part) """


@query(_PATHS + """, bare AS (SELECT path, string_split(regexp_replace(regexp_replace(path, '[.]pyi?$', ''), '/__init__$', ''), '/') AS parts FROM paths WHERE path LIKE '%.py' OR path LIKE '%.pyi')
  SELECT DISTINCT array_to_string(parts[i:], '.') AS name, path FROM bare, unnest(range(1, 1 + len(parts))) AS t(i)""")
def module_index(spark, sf):
    return source_code.module_names(_paths(spark, sf))


@query(_PATHS + "SELECT path, CASE WHEN path LIKE '%.py' OR path LIKE '%.pyi' THEN 'python' WHEN path LIKE '%.java' THEN 'java' END AS parser FROM paths")
def parser_by_ending(spark, sf):
    return _paths(spark, sf).withColumn("parser", source_code.parser_for("path"))


@query(_PATHS + "SELECT path FROM (SELECT path FROM paths WHERE k % 6 <> 4 UNION SELECT 'new/f' || p_partkey || '.py' FROM part UNION SELECT path FROM paths WHERE k % 3 = 0)")
def scope_paths(spark, sf):
    """What the index reads: tracked files with the changed ones, once each, without our own."""
    changed = adapter.table(spark, sf, "part").select(F.expr("concat('new/f', p_partkey, '.py')").alias("path"))
    return analysis.not_own(analysis.known_paths(_paths(spark, sf), changed))


_JAVA = "package com.acme.p{0};\n\nimport java.util.List;\nimport static com.acme.p{1}.K{2}.run;\n  import com.acme.q.*;\nimportant text;\npublic class K{3} {{}}\n"


def _java(spark, sf):
    k = "p_partkey"
    parts = [f"{k} % 5", f"{k} % 4", f"{k} % 30", k]
    pieces = [F.lit(p.replace("{{}}", "{}")) for p in _JAVA.replace("{0}", "\0").replace("{1}", "\0").replace("{2}", "\0").replace("{3}", "\0").split("\0")]
    body = F.concat(pieces[0], *(x for p, piece in zip(parts, pieces[1:], strict=True) for x in (F.expr(f"cast({p} AS string)"), piece)))
    return adapter.table(spark, sf, "part").select(F.expr(f"concat('src/K', {k}, if({k} % 9 = 0, '.kt', '.java'))").alias("path"), body.alias("source"))


@query("""SELECT 'src/K' || p_partkey || '.java' AS src, unnest(['java.util.List', 'com.acme.p' || (p_partkey % 4) || '.K' || (p_partkey % 30), 'com.acme.q.*']) AS ref FROM part WHERE p_partkey % 9 <> 0""")
def java_imports(spark, sf):
    return source_code.java_imports(_java(spark, sf))


@query("SELECT 'com.acme.p' || (p_partkey % 5) || '.K' || p_partkey AS name, 'src/K' || p_partkey || '.java' AS path FROM part WHERE p_partkey % 9 <> 0")
def java_index(spark, sf):
    return source_code.java_names(_java(spark, sf))


@query("""WITH code AS (SELECT p_partkey AS k, 'pkg' || (p_partkey % 25) || '.sub' AS here FROM part WHERE p_partkey % 13 <> 0)
  SELECT 'pkg' || (k % 25) || '/sub/m' || k || '.py' AS src, unnest(['os', 'pkg' || (k % 7) || '.m' || (k % 5), here, here || '.sibling' || (k % 3), 'pkg' || (k % 25) || '.top', 'pkg' || (k % 25) || '.top.*']) AS ref FROM code""")
def python_imports(spark, sf):
    """Absolute, relative and star imports; files that don't parse give none, and one climbs beyond the root."""
    return source_code.python_imports(_python(spark, sf))


def _python(spark, sf):
    code = """concat('import os, pkg', p_partkey % 7, '.m', p_partkey % 5, '\nfrom . import sibling', p_partkey % 3, '\nfrom ..top import *\nfrom .....far import x\n',
      if(p_partkey % 13 = 0, 'def broken(:', concat('def f(x):\n', repeat('    if x:\n        x = 1\n', cast(p_partkey % 4 AS int)), '    if x and x > 1:\n        return [y for y in x if y]\n    return 0\n',
        if(p_partkey % 3 = 0, '\ndef g():\n    return 1\n', ''))))"""
    return adapter.table(spark, sf, "part").select(F.expr("concat('pkg', p_partkey % 25, '/sub/m', p_partkey, '.py')").alias("path"), F.expr(code).alias("source"))


@query("""SELECT 'pkg' || (k % 25) || '/sub/m' || k || '.py' AS path, CASE WHEN k % 3 = 0 THEN (5 + k % 4) / 2.0::DOUBLE ELSE CAST(4 + k % 4 AS DOUBLE) END AS average_ccn, CAST(4 + k % 4 AS INT) AS max_ccn,
  CAST(8 + 2 * (k % 4) + CASE WHEN k % 3 = 0 THEN 2 ELSE 0 END AS INT) AS nloc, CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END AS function_count FROM (SELECT p_partkey AS k FROM part WHERE p_partkey % 13 <> 0)""")
def file_complexity(spark, sf):
    return source_code.complexity(_python(spark, sf))


_WILD = "SELECT DISTINCT r.src, r.ref, i.path FROM refs r JOIN index_ i ON r.ref LIKE '%.*' AND regexp_extract(i.name, '^(.*)\\.', 1) = r.ref[1:length(r.ref) - 2] AND i.name LIKE '%.%'"


@query(sql.REFERENCES + f""", one AS (SELECT src, ref, any_value(path) AS path FROM resolved GROUP BY src, ref HAVING count(DISTINCT path) = 1), wild AS ({_WILD})
  SELECT src, path AS dst FROM one WHERE src <> path UNION SELECT src, path FROM wild WHERE src <> path""")
def import_graph(spark, sf):
    """Edges from references and index: unambiguous longest prefixes and stars."""
    return graph.build_edges(*_references(spark, sf))


@query(sql.REFERENCES + f""", wild AS ({_WILD}), hits2 AS (SELECT src, ref, count(DISTINCT path) > 1 AS several FROM resolved GROUP BY src, ref UNION SELECT src, ref, false FROM wild)
  SELECT count(*) FILTER (several IS NULL) AS unresolved, count(*) FILTER (several) AS ambiguous FROM (SELECT DISTINCT src, ref FROM refs) LEFT JOIN hits2 USING (src, ref)""")
def reference_counts(spark, sf):
    return graph.reference_counts(*_references(spark, sf))


@query(f"""SELECT CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN 'scan' WHEN 1 THEN 'diff' ELSE 'all' END AS mode,
  CASE CAST(p_partkey % 3 AS INT) {" ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(analysis.MODES.values()))} END AS description, count(*) AS n FROM part GROUP BY 1, 2""")
def mode_descriptions(spark, sf):
    mode = F.expr("CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN 'scan' WHEN 1 THEN 'diff' ELSE 'all' END")
    return adapter.table(spark, sf, "part").select(mode.alias("mode")).withColumn("description", analysis.described("mode")).groupBy("mode", "description").agg(F.count(F.lit(1)).alias("n"))
