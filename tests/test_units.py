"""Scalar functions, graphs, renames, metrics and payloads against hand-made values and direct computations."""

import json
import math
import random

from pyspark.sql import functions as F

from churnlens.config import Blast, Settings
from churnlens.functions import source_code, text
from churnlens.operators import graph, history, metrics, renames
from churnlens.plans import comment, payload


def column(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(f(F.col("x"))).collect()]


def test_bugfix(spark):
    messages = ["Fix crash", "fixes #12", "resolved PROJ-42", "Add (#12)", "prefix and suffix", "Closes #1", "closes #1", "feature\nfix in the body", None]
    assert column(spark, messages, text.is_bugfix) == [True, True, True, False, False, False, True, False, False]


def test_rename_notation(spark):
    raw = ["a.py", "a.py => b.py", "app/{old => new}/c.py", "{ => src}/m.py", "a/{b => }/c.py"]
    assert [tuple(r) for r in column(spark, raw, text.split_rename)] == [("a.py", "a.py"), ("a.py", "b.py"), ("app/old/c.py", "app/new/c.py"), ("m.py", "src/m.py"), ("a/b/c.py", "a/c.py")]


def test_paths(spark):
    tests = ["tests/x.py", "src/test_a.py", "a_test.go", "x.spec.ts", "CoreTest.java", "Test.java", "src/app.py", "Contest.py", "TESTS/a.md"]
    assert column(spark, tests, text.is_test_path) == [True, True, True, True, True, False, False, False, True]
    assert column(spark, ["a.py", "b.MD", "Makefile", "x/y.JSX"], text.is_code_path) == [True, False, False, True]
    assert column(spark, ["a/b/c.py", "c.py"], text.folder) == ["a/b", ""]


def test_dates(spark):
    got = column(spark, ["2011-03-01T02:00:00+518:00", "2020-01-01T00:00:00+02:00", "garbage"], text.commit_instant)
    assert got[0].hour == 2 and got[1].day == 31 and got[2] is None


def test_nearest_rank(spark):
    for n in (1, 2, 19, 20, 41):
        values = [random.Random(n).randint(0, 9) for _ in range(n)]
        got = history.nearest_rank(spark.createDataFrame([(v,) for v in values], "v long"), "v", {"q75": 0.75, "q90": 0.9}).first()
        assert (got["q75"], got["q90"]) == tuple(sorted(values)[round(q * (n - 1))] for q in (0.75, 0.9))
    assert history.nearest_rank(spark.createDataFrame([], "v long"), "v", {"q": 0.5}).first()["q"] == 0


def test_running_counts_do_not_see_their_own_commit(spark):
    rows = [("p", "s1", 1, "a", True), ("p", "s2", 2, "b", False), ("p", "s2", 2, "b", False), ("p", "s3", 3, "a", True)]
    got = history.running_history(spark.createDataFrame(rows, "path string, sha string, seq long, author string, is_bugfix boolean")).orderBy("seq").collect()
    assert [(r["prior_commits"], r["prior_fixes"], r["prior_by_author"]) for r in got] == [(0, 0, 0), (1, 1, 0), (1, 1, 0), (3, 1, 1)]


def test_renames_equal_a_walk_of_the_log(spark):
    rng = random.Random(3)
    touches, moves, expected = [], [], {}
    for script in range(12):
        names, today = [f"{script}/{c}" for c in "abcd"], {}

        def follow(path, today=None):
            seen = set()
            while path in today and path not in seen:
                seen.add(path)
                path = today[path]
            return path

        for pos in range(script * 1000, script * 1000 + 25):
            new = rng.choice(names)
            expected[pos, new] = follow(new, today)
            touches.append((pos, new))
            if rng.random() < 0.5:
                old = rng.choice(names)
                today[old] = follow(new, today)
                moves.append((pos, old, new))
    got = renames.canonical_paths(spark.createDataFrame(touches, "pos long, path string"), spark.createDataFrame(moves, "pos long, old_path string, new_path string"))
    assert {(r["pos"], r["path"]): r["canonical"] for r in got.collect()} == expected


def test_renames_stay_in_their_repository(spark):
    touches = spark.createDataFrame([("x", 5, "a.py"), ("y", 5, "a.py")], "repo string, pos long, path string")
    moves = spark.createDataFrame([("x", 1, "a.py", "b.py")], "repo string, pos long, old_path string, new_path string")
    got = {r["repo"]: r["canonical"] for r in renames.canonical_paths(touches, moves, "repo").collect()}
    assert got == {"x": "b.py", "y": "a.py"}


def test_metrics(spark):
    def both(pairs):
        d = spark.createDataFrame(pairs, "label int, score double")
        return metrics.roc_auc(d).first()[0], metrics.pr_auc(d).first()[0]

    assert both([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)]) == (1.0, 1.0)
    assert both([(0, 0.5), (1, 0.5)])[0] == 0.5
    assert round(both([(1, 0.9), (0, 0.8), (1, 0.7)])[1], 4) == 0.8333
    assert all(map(math.isnan, both([(0, 0.3), (0, 0.4)])))
    rows = spark.createDataFrame([(i % 3, i) for i in range(10)], "day int, id int")
    split = metrics.time_split(rows, 0.75, "day", "id").collect()
    assert sum(r["is_train"] for r in split) == 7
    order = [r["is_train"] for r in sorted(split, key=lambda r: (r["day"], r["id"]))]
    assert order == sorted(order, reverse=True)


def test_graph(spark):
    edges = spark.createDataFrame([("service", "repo"), ("report", "repo"), ("api", "service"), ("worker", "service"), ("a", "b"), ("b", "a"), ("x", "a")], "src string, dst string")
    got = {r["root"]: r for r in graph.impact(edges, spark.createDataFrame([("repo",), ("a",), ("x",)], "root string"), Blast(max_depth=1)).collect()}
    assert got["repo"]["direct"] == ["report", "service"] and got["repo"]["depth_capped"] and not got["repo"]["in_cycle"]
    assert got["a"]["in_cycle"] and got["x"]["direct_count"] == 0 and got["x"]["direct"] == []
    deep = graph.impact(edges, spark.createDataFrame([("repo",)], "root string")).first()
    assert (deep["transitive"], deep["depth_capped"]) == (["api", "worker"], False)


def test_imports(spark):
    sources = [("pkg/a.py", "import os\nfrom .b import c\nfrom .. import d\nfrom ...far import e\nfrom .q import *"), ("pkg/bad.py", "def ("), ("src/x/K.java", "package x;\nimport y.Z;\nimport static y.Q.run;\nimport w.*;\n")]
    d = spark.createDataFrame(sources, "path string, source string")
    assert {tuple(r) for r in source_code.python_imports(d).collect()} == {("pkg/a.py", x) for x in ("os", "pkg.b", "pkg.b.c", "pkg.q", "pkg.q.*")}
    relative = source_code.python_references
    assert relative("a/b/c/m.py", "from .....x import y") == [] and relative("a/b/c/m.py", "from ..x import y") == ["a.b.x", "a.b.x.y"]
    assert relative("a/b/__init__.py", "from . import z") == ["a", "a.z"] and relative("m.py", "from . import z") == []
    assert {r["ref"] for r in source_code.java_imports(d).collect()} == {"y.Z", "y.Q", "w.*"}
    assert [tuple(r) for r in source_code.java_names(d).collect()] == [("x.K", "src/x/K.java")]
    index = spark.createDataFrame([("y.Z", "Z.java"), ("w.A", "A.java"), ("w.A.b", "b.java")], "name string, path string")
    refs = spark.createDataFrame([("k", "y.Z.inner"), ("k", "w.*"), ("Z.java", "y.Z")], "src string, ref string")
    assert {tuple(r) for r in graph.build_edges(refs, index).collect()} == {("k", "Z.java"), ("k", "A.java")}


def test_complexity():
    assert source_code.function_complexities("a.py", "def f(x):\n  if x and y: return 1\n  for i in x: pass") == [4]
    assert source_code.function_complexities("a.java", "class A { int f(int x) { if (x > 0 && x < 9) { return 1; } return 0; } }") == [3]
    assert source_code.function_complexities("a.md", "x") is None and source_code.function_complexities("a.py", "def (") is None


def test_payload(spark):
    from churnlens.plans import extras

    doc = json.loads(extras.payload_json(spark, "/root/testdata/sf0.001").first()["payload"])
    assert doc["schema_version"] == 5 and doc["blast_radius"] == {"analyzed": False, "direct_count": 0, "transitive_count": 0} and "ai_explanation" in doc
    assert doc["files"] == sorted(doc["files"], key=lambda f: (-f["score"], f["path"]))
    blast = {"analyzed": True, "direct_count": 1, "transitive_count": 2, "max_depth": 3, "direct": ["x.py"], "hubs": ["h.py"], "cycle_files": ["c.py"], "files_omitted": 4}
    told = {"available": True, "generated_by": "w", "summary": "because", "rollout": ""}
    said = comment.comment(doc | {"score": 80, "band": "high", "blast_radius": blast, "ai_explanation": told, "warnings": ["old model"]}, threshold=65)
    assert said.startswith(comment.MARKER) and "set to 65" in said and "80 of 100, high" in said
    assert all(x in said for x in ("`x.py`", "`h.py`", "`c.py`", "4 less risky", "because", "old model"))
    assert "gate" not in comment.comment({}, threshold=65) and "How to ship" not in said
    assert comment.exceeds({"score": 65}, 65) and not comment.exceeds({}, 1)


def test_settings():
    made = Settings.from_env({"CHURNLENS_WEIGHTS__HOT_POINTS": "33", "CHURNLENS_BUGFIX__KEYWORDS": '["oops"]'})
    assert made.weights.hot_points == 33 and made.bugfix.keywords == ("oops",) and made.blast.hub == 20
