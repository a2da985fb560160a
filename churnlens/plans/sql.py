"""The catalogue's results as DuckDB SQL: common table expressions that build on each other."""

from ..config import BugfixDetection, RiskWeights
from ..operators.rules import HEADLINES, HINTS

_C, _W = BugfixDetection(), RiskWeights()
_quote = lambda s: "'" + s.replace("'", "''") + "'"

COMMITS = f"""WITH RECURSIVE base AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS sha, o_orderkey, 'author_' || CAST(o_custkey % 40 AS VARCHAR) AS author,
    o_orderdate + to_seconds(CAST((o_orderkey * 7919) % 86400 AS BIGINT)) AS when_local,
    CASE CAST(o_orderkey % 8 AS INT) WHEN 0 THEN 'fix: off-by-one' WHEN 1 THEN 'Add pooling (#1234)' WHEN 2 THEN 'rename prefix and suffix' WHEN 3 THEN 'closes #123'
      WHEN 4 THEN 'Closes #123' WHEN 5 THEN 'resolved PROJ-42' WHEN 6 THEN 'Hotfix for prod' ELSE 'PROJ-42 add pagination' END AS subject
  FROM orders),
commits AS (SELECT *, regexp_matches(subject, {_quote(_C.keyword_pattern)}) OR regexp_matches(subject, {_quote(_C.issue_pattern)}) AS is_bugfix,
  CAST(epoch(when_local) AS BIGINT) * 2147483648 + o_orderkey AS seq FROM base)
"""
_TOUCHES = """, touches AS (SELECT c.*, l_partkey, CASE CAST(l_partkey % 10 AS INT) WHEN 0 THEN 'tests/test_m' || CAST(l_partkey + 1 AS VARCHAR) || '.py' WHEN 9 THEN 'docs/d' || CAST(l_partkey AS VARCHAR) || '.md'
    ELSE 'pkg' || CAST(l_partkey % 25 AS VARCHAR) || '/m' || CAST(l_partkey AS VARCHAR) || '.py' END AS path,
  CAST(l_quantity AS INT) AS lines_added, CAST(round(l_discount * 100) AS INT) AS lines_deleted FROM commits c JOIN lineitem ON o_orderkey = l_orderkey)
"""
TOUCHES = COMMITS + _TOUCHES
_HISTORY = """, history AS (SELECT path, count(*) AS total_commits, CAST(sum(CAST(is_bugfix AS INT)) AS BIGINT) AS bugfix_commits, max(when_local) AS last_changed FROM touches GROUP BY path)
"""
HISTORY = TOUCHES + _HISTORY


def _rank(values: str, q: float) -> str:
    return f"coalesce((SELECT list(v ORDER BY v)[CAST(round_even({q}::DOUBLE * (count(*) - 1), 0) AS BIGINT) + 1] FROM ({values})), 0)"


_FIXED = "SELECT bugfix_commits AS v FROM history WHERE bugfix_commits > 0"
_ALL = "SELECT total_commits AS v FROM history"
_DISTRIBUTION = f""", distribution AS (SELECT {_rank(_FIXED, 0.75)} AS bugfix_hot, {_rank(_FIXED, 0.9)} AS bugfix_very_hot, (SELECT count(*) FROM history WHERE bugfix_commits > 0) AS fixed_files,
  {_rank(_ALL, 0.9)} AS churn_high, (SELECT count(*) FROM history) AS files, (SELECT count(*) >= 20 AND count(*) FILTER (bugfix_commits > 0) >= 20 FROM history) AS meaningful)
"""
DISTRIBUTION = HISTORY + _DISTRIBUTION
_LIMITS = f""", limits AS (SELECT CASE WHEN meaningful THEN greatest({_W.hot_bugfixes}, bugfix_hot) ELSE {_W.hot_bugfixes} END::BIGINT AS hot_bugfixes,
  CASE WHEN meaningful THEN greatest({_W.very_hot_bugfixes}, bugfix_very_hot) ELSE {_W.very_hot_bugfixes} END::BIGINT AS very_hot_bugfixes,
  CASE WHEN meaningful THEN greatest({_W.churn_commits}, churn_high) ELSE {_W.churn_commits} END::BIGINT AS churn_commits, meaningful AS relative_thresholds FROM distribution)
"""
LIMITS = DISTRIBUTION + _LIMITS
_PATHS = """, paths AS (SELECT path, path LIKE 'tests/%' AS is_test, path LIKE '%.py' AS is_code, regexp_extract(path, '^(.*)/', 1) AS folder FROM (SELECT DISTINCT path FROM touches))
"""
PATHS = TOUCHES + _PATHS
_TESTS = """, tests AS (SELECT p.path, t.path AS test_path FROM paths p JOIN paths t ON t.is_test AND t.path = 'tests/test_' || regexp_extract(p.path, '([^/]*)$', 1) WHERE p.is_code AND NOT p.is_test)
"""
TESTS = PATHS + _TESTS
_RUNNING = """, running AS (SELECT *, count(*) OVER w AS prior_commits, CAST(coalesce(sum(CAST(is_bugfix AS INT)) OVER w, 0) AS BIGINT) AS prior_fixes, count(*) OVER a AS prior_by_author
  FROM touches WINDOW w AS (PARTITION BY path ORDER BY seq RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY path, author ORDER BY seq RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""
RUNNING = TOUCHES + _RUNNING
_OWNED = "CASE WHEN prior_commits > 0 THEN CAST(prior_by_author AS DOUBLE) / prior_commits END"
FEATURES = RUNNING + f""", rows AS (SELECT r.*, {_OWNED} AS owned, p_size AS max_ccn FROM running r LEFT JOIN part ON p_partkey = l_partkey AND p_partkey % 7 <> 0),
features AS (SELECT sha, CAST(sum(lines_added) AS DOUBLE) AS lines_added, CAST(sum(lines_deleted) AS DOUBLE) AS lines_deleted, CAST(sum(lines_added + lines_deleted) AS DOUBLE) AS lines_changed,
  CAST(count(*) AS DOUBLE) AS files_changed, CAST(count(DISTINCT regexp_extract(path, '^(.*)/', 1)) AS DOUBLE) AS folders_touched,
  CAST(coalesce(max(prior_commits) FILTER (prior_commits > 0), 0) AS DOUBLE) AS max_file_commits, round(coalesce(avg(prior_commits) FILTER (prior_commits > 0), 0), 9) AS mean_file_commits,
  CAST(coalesce(max(prior_fixes) FILTER (prior_commits > 0), 0) AS DOUBLE) AS max_file_bugfixes, round(coalesce(avg(prior_fixes) FILTER (prior_commits > 0), 0), 9) AS mean_file_bugfixes,
  CAST(count(*) FILTER (prior_commits = 0) AS DOUBLE) AS new_files, round(coalesce(min(owned), 0), 9) AS min_author_ownership, round(coalesce(avg(owned), 0), 9) AS mean_author_ownership,
  CAST(count(*) FILTER (prior_commits > 0 AND prior_by_author = 0) AS DOUBLE) AS files_author_never_touched, CAST(coalesce(max(max_ccn), 0) AS DOUBLE) AS max_complexity, round(coalesce(avg(max_ccn), 0), 9) AS mean_complexity,
  CAST(count(*) FILTER (path LIKE '%.py') AS DOUBLE) AS code_files_changed, CAST(count(*) FILTER (path LIKE 'tests/%') AS DOUBLE) AS test_files_changed,
  CAST(hour(any_value(when_local)) AS DOUBLE) AS hour_of_day, CAST(isodow(any_value(when_local)) - 1 AS DOUBLE) AS day_of_week, CASE WHEN isodow(any_value(when_local)) >= 6 THEN 1.0 ELSE 0.0 END::DOUBLE AS is_weekend
  FROM rows GROUP BY sha)
"""
_CHANGED = _HISTORY + _DISTRIBUTION + _LIMITS + _PATHS + _TESTS + _RUNNING + """, test_lists AS (SELECT path, list(test_path ORDER BY test_path) AS tests FROM tests GROUP BY path),
fresh AS (SELECT DISTINCT f.sha, f.path FROM touches f JOIN tests t USING (path) JOIN touches g ON g.sha = f.sha AND g.path = t.test_path),
files AS (SELECT r.sha, r.path, any_value(r.author) AS author, any_value(r.when_local) AS when_local, CAST(sum(lines_added) AS BIGINT) AS lines_added, CAST(sum(lines_deleted) AS BIGINT) AS lines_deleted,
    max(prior_commits) AS prior_commits, max(prior_fixes) AS prior_fixes, max(prior_by_author) AS prior_by_author, any_value(p_size) AS max_ccn
  FROM running r LEFT JOIN part ON p_partkey = l_partkey AND p_partkey % 7 <> 0 GROUP BY r.sha, r.path),
wide AS (SELECT f.*, p.is_test, p.is_code, t.tests, x.path IS NOT NULL AS tests_changed, l.*, CASE WHEN prior_commits > 0 THEN CAST(prior_by_author AS DOUBLE) / prior_commits ELSE 0 END AS owned
  FROM files f JOIN paths p USING (path) LEFT JOIN test_lists t USING (path) LEFT JOIN fresh x ON x.sha = f.sha AND x.path = f.path CROSS JOIN limits l)
"""
_REASONS = f""", file_reasons AS (
  SELECT sha, path, 10 AS ord, 'hot_file' AS rule, CASE WHEN prior_fixes >= very_hot_bugfixes THEN {_W.very_hot_points} ELSE {_W.hot_points} END AS points,
    prior_fixes || ' past bug-fix commits (threshold ' || CASE WHEN prior_fixes >= very_hot_bugfixes THEN very_hot_bugfixes ELSE hot_bugfixes END || ')' AS detail
    FROM wide WHERE prior_commits > 0 AND prior_fixes >= least(hot_bugfixes, very_hot_bugfixes)
  UNION ALL SELECT sha, path, 11, CASE WHEN tests IS NULL THEN 'missing_tests' ELSE 'stale_tests' END, CASE WHEN tests IS NULL THEN {_W.no_test_file_points} ELSE {_W.stale_test_points} END,
    CASE WHEN tests IS NULL THEN 'searched the usual naming conventions and test directories' ELSE 'unchanged: ' || array_to_string(tests[1:3], ', ') END FROM wide WHERE is_code AND NOT is_test AND NOT (tests IS NOT NULL AND tests_changed)
  UNION ALL SELECT sha, path, 12, 'high_complexity', CASE WHEN max_ccn >= {_W.very_high_ccn} THEN {_W.very_high_ccn_points} ELSE {_W.high_ccn_points} END,
    'peak cyclomatic complexity ' || max_ccn || ' (threshold ' || CASE WHEN max_ccn >= {_W.very_high_ccn} THEN {_W.very_high_ccn} ELSE {_W.high_ccn} END || ')' FROM wide WHERE max_ccn >= {_W.high_ccn}
  UNION ALL SELECT sha, path, 13, CASE WHEN prior_by_author = 0 THEN 'author_new_to_file' ELSE 'low_ownership' END, CASE WHEN prior_by_author = 0 THEN {_W.new_to_file_points} ELSE {_W.low_ownership_points} END,
    CASE WHEN prior_by_author = 0 THEN author || ' has 0 of its ' || prior_commits || ' past commits'
      ELSE author || ' made ' || prior_by_author || ' of ' || prior_commits || ' past commits (' || CAST(round_even(owned * 100, 0) AS INT) || '%)' END FROM wide WHERE prior_commits > 0 AND owned < {_W.low_ownership}
  UNION ALL SELECT sha, path, 14, 'large_edit', CASE WHEN lines_added + lines_deleted >= {_W.file_large_lines} THEN {_W.file_large_points} ELSE {_W.file_moderate_points} END,
    (lines_added + lines_deleted) || ' lines changed (threshold ' || CASE WHEN lines_added + lines_deleted >= {_W.file_large_lines} THEN {_W.file_large_lines} ELSE {_W.file_moderate_lines} END || ')' FROM wide WHERE lines_added + lines_deleted >= {_W.file_moderate_lines}
  UNION ALL SELECT sha, path, 15, 'churn', {_W.churn_points}, prior_commits || ' commits touched it (threshold ' || churn_commits || ')' FROM wide WHERE prior_commits > 0 AND prior_commits >= churn_commits)
"""
REASONS = TOUCHES + _CHANGED + _REASONS
_BAND = f"CASE WHEN score >= {_W.high_band_score} THEN 'high' WHEN score >= {_W.medium_band_score} THEN 'medium' ELSE 'low' END AS band"
_FILE_SCORES = f""", summed AS (SELECT sha, path, CAST(least({_W.max_score}, sum(points)) AS INT) AS score, string_agg(rule || ':' || points, ',' ORDER BY points DESC, ord) AS reasons FROM file_reasons GROUP BY sha, path),
file_scores AS (SELECT sha, path, score, {_BAND}, reasons, author, when_local, lines_added, lines_deleted
  FROM (SELECT w.sha, w.path, coalesce(s.score, 0) AS score, coalesce(s.reasons, '') AS reasons, author, when_local, lines_added, lines_deleted FROM wide w LEFT JOIN summed s USING (sha, path)))
"""
FILE_SCORES = REASONS + _FILE_SCORES
CHANGE_SCORES = FILE_SCORES + f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY score DESC, path) AS rank FROM file_scores),
changes AS (SELECT sha, count(*) AS n_files, CAST(sum(lines_added + lines_deleted) AS BIGINT) AS n_lines, any_value(when_local) AS when_local, max(score) AS worst FROM file_scores GROUP BY sha),
context AS (
  SELECT sha, 0 AS ord, 'broad_change' AS rule, {_W.broad_files_points} AS points, n_files || ' files (threshold {_W.broad_files})' AS detail FROM changes WHERE n_files >= {_W.broad_files}
  UNION ALL SELECT sha, 1, 'broad_change', {_W.broad_lines_points}, n_lines || ' lines across ' || n_files || ' files' FROM changes WHERE n_lines >= {_W.broad_lines}
  UNION ALL SELECT sha, 2, 'weekend_deploy', {_W.weekend_points}, strftime(when_local, '%A %H:%M') FROM changes WHERE isodow(when_local) >= 6
  UNION ALL SELECT sha, 3, 'late_night_deploy', {_W.late_night_points}, strftime(when_local, '%A %H:%M') FROM changes WHERE hour(when_local) >= {_W.late_night_start_hour} OR hour(when_local) < {_W.late_night_end_hour}),
every AS (SELECT sha, ord, rule, points, detail, CAST(NULL AS VARCHAR) AS path FROM context UNION ALL SELECT f.sha, f.ord, f.rule, f.points, f.detail, f.path FROM file_reasons f JOIN ranked r ON r.sha = f.sha AND r.path = f.path AND r.rank = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY points DESC, ord) AS place FROM every),
top AS (SELECT sha, string_agg(points || ' ' || rule || ' ' || coalesce(path, '-') || ' ' || detail, ' | ' ORDER BY place) AS reasons FROM placed WHERE place <= 5 GROUP BY sha),
change_scores AS (SELECT sha, score, {_BAND}, n_files, n_lines, reasons FROM (SELECT c.sha, CAST(least({_W.max_score}, worst + coalesce(p, 0)) AS INT) AS score, n_files, n_lines, coalesce(reasons, '') AS reasons
  FROM changes c LEFT JOIN (SELECT sha, sum(points) AS p FROM context GROUP BY sha) USING (sha) LEFT JOIN top USING (sha)))
"""
_HINTS = ", ".join(f"({_quote(k)}, {_quote(v)})" for k, v in HINTS.items())
_HEADS = ", ".join(f"({_quote(k)}, {_quote(v)})" for k, v in HEADLINES.items())
RECOMMENDATION = CHANGE_SCORES + f""", hints(rule, hint) AS (VALUES {_HINTS}), heads(band, head) AS (VALUES {_HEADS}),
firsts AS (SELECT sha, hint, min(place) AS place FROM placed JOIN hints USING (rule) GROUP BY sha, hint),
two AS (SELECT sha, string_agg(hint, '; ' ORDER BY place) AS hint FROM (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY place) AS n FROM firsts) WHERE n <= 2 GROUP BY sha)
SELECT sha, CASE WHEN hint IS NULL THEN head ELSE head || ' Suggested: ' || hint || '.' END AS recommendation FROM change_scores JOIN heads USING (band) LEFT JOIN two USING (sha)"""
SCORED = "WITH scored AS (SELECT toxic AS label, CAST(n_chars AS DOUBLE) AS score FROM labels JOIN documents USING (doc_id)) "
EDGES = "WITH RECURSIVE edges AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_partkey <> l_suppkey) "


def _walk(roots: str) -> str:
    return f""", roots AS ({roots}), walk(root, node, depth) AS (SELECT root, root, 0 FROM roots UNION SELECT w.root, e.src, w.depth + 1 FROM walk w JOIN edges e ON e.dst = w.node WHERE w.depth < 4),
near AS (SELECT root, node, min(depth) AS depth FROM walk GROUP BY root, node), reached AS (SELECT root, node, CAST(depth AS INT) AS depth FROM near WHERE depth BETWEEN 1 AND 3) """


_WALK = _walk("SELECT DISTINCT dst AS root FROM edges")


def rolled_up(analyzed: int) -> str:
    """The reach of all imported files as one change, of which the first ``analyzed`` are looked at."""
    return EDGES + _walk(f"SELECT DISTINCT dst AS root FROM edges ORDER BY root LIMIT {analyzed}") + f"""SELECT count(*) FILTER (depth = 1) AS direct_count, count(*) FILTER (depth > 1) AS transitive_count,
  (SELECT greatest(count(DISTINCT dst) - {analyzed}, 0) FROM edges) AS files_omitted FROM (SELECT node, min(depth) AS depth FROM reached WHERE node NOT IN (SELECT dst FROM edges) GROUP BY node)"""


REACHED = EDGES + _WALK
IMPACT = REACHED + """, reach(src, dst) AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src), loops AS (SELECT DISTINCT src FROM reach WHERE src = dst),
ordered AS (SELECT *, row_number() OVER (PARTITION BY root, depth = 1 ORDER BY node) AS n FROM reached),
impact AS (SELECT root, count(o.node) FILTER (depth = 1) AS direct_count, count(o.node) FILTER (depth > 1) AS transitive_count,
  coalesce(string_agg(CAST(o.node AS VARCHAR), ',' ORDER BY o.node) FILTER (depth = 1 AND n <= 12), '') AS direct, coalesce(string_agg(CAST(o.node AS VARCHAR), ',' ORDER BY o.node) FILTER (depth > 1 AND n <= 12), '') AS transitive,
  root IN (SELECT src FROM loops) AS in_cycle, root IN (SELECT root FROM near WHERE depth = 4) AS depth_capped, count(o.node) FILTER (depth = 1) >= 20 AS is_hub
  FROM roots LEFT JOIN ordered o USING (root) GROUP BY root) """
REFERENCES = """WITH refs AS (SELECT 'f' || CAST(p_partkey AS VARCHAR) AS src, CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'pkg' || (p_partkey % 25) || '.*' WHEN 1 THEN 'pkg' || (p_partkey % 25) || '.m' || (p_partkey % 40) || '.name'
    WHEN 2 THEN 'pkg' || (p_partkey % 25) || '.m' || (p_partkey % 40) ELSE 'os.path' END AS ref FROM part),
index_ AS (SELECT 'pkg' || (p_partkey % 25) || '.m' || (p_partkey % 50) AS name, 'pkg' || (p_partkey % 25) || '/m' || (p_partkey % 50) || CASE WHEN p_partkey % 11 = 0 THEN '/__init__.py' ELSE '.py' END AS path FROM part
  UNION SELECT 'pkg' || (p_partkey % 25), 'pkg' || (p_partkey % 25) || '/__init__.py' FROM part),
hits AS (SELECT DISTINCT r.src, r.ref, i.path, length(i.name) AS len FROM refs r JOIN index_ i ON r.ref NOT LIKE '%.*' AND (r.ref = i.name OR starts_with(r.ref, i.name || '.'))),
resolved AS (SELECT src, ref, path FROM hits h WHERE len = (SELECT max(len) FROM hits g WHERE g.src = h.src AND g.ref = h.ref)) """
