"""Sources over real repositories, the model, and the stream."""

import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlens.operators import history, model
from churnlens.plans import extras
from churnlens.sources import gitlog
from churnlens.streaming import running

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")

    def commit(message, author="Alice", **files):
        for name, content in files.items():
            path = root / name.replace("__", "/").replace("_py", ".py")
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(content)
        subprocess.run(["git", "-C", root, "add", "-A"], check=True)
        subprocess.run(["git", "-C", root, "-c", f"user.name={author}", "-c", "user.email=x@example.com", "commit", "-qm", message], check=True)

    subprocess.run(["git", "init", "-q", "-b", "main", root], check=True)
    commit("start", app__core_py="def f(x):\n    return x\n", app__util_py="a = 1\n")
    commit("add a branch", "Bob", app__core_py="def f(x):\n    return x + 1\n")
    commit("unrelated", app__util_py="a = 2\n")
    commit("fix: wrong sum", app__core_py="def f(x):\n    return x + 2\n")
    subprocess.run(["git", "-C", root, "mv", "app/core.py", "app/main.py"], check=True)
    commit("move")
    return root


def test_log(spark, repo):
    commits, touches = gitlog.read_log(spark, str(repo))
    assert [r["subject"] for r in commits.orderBy("seq").collect()] == ["start", "add a branch", "unrelated", "fix: wrong sum", "move"]
    got = {r["path"]: r for r in history.file_history(touches).collect()}
    assert set(got) == {"app/main.py", "app/util.py"}  # the rename is followed
    assert (got["app/main.py"]["total_commits"], got["app/main.py"]["bugfix_commits"]) == (4, 1)


def test_other_sources(spark, repo):
    gitlog.register(spark)
    files = spark.read.format("gitfiles").option("path", str(repo)).load()
    assert {r["line"] for r in files.collect()} == {"app/main.py", "app/util.py"}
    blobs = spark.read.format("gitblob").option("path", str(repo)).load().select(F.substring_index("line", gitlog.FIELD, 1).alias("path"))
    assert blobs.count() == 2
    diff = spark.read.format("gitdiff").option("path", str(repo)).option("base", "HEAD~2").option("head", "HEAD").load()
    assert diff.count() >= 1
    assert gitlog.resolve_base(str(repo))[0] == "main"


def test_blame_finds_the_inducing_commit(spark, repo):
    commits, _ = gitlog.read_log(spark, str(repo))
    by = {r["subject"]: r["sha"] for r in commits.collect()}
    got = gitlog.blame_inducing(commits.where("is_bugfix")).collect()
    assert [(r["fix_sha"], r["inducing_sha"]) for r in got] == [(by["fix: wrong sum"], by["add a branch"])]


def test_model_adds_up(spark, tmp_path):
    rows = extras.training_rows(spark, SF).cache()
    fitted = model.fit(rows, 5, extras.CONFIG)
    trees = model.trees_of(spark, fitted)
    x = rows.limit(50).toPandas()[model.NAMES].to_numpy(float)
    impact, base = trees.contributions(x)
    assert np.allclose(impact.sum(1) + base, 2 * trees.outputs(x).sum(1))
    ours = model.predict(rows, fitted).toPandas()
    assert np.allclose(ours["probability"], 1 / (1 + np.exp(-2 * trees.outputs(ours[model.NAMES].to_numpy(float)).sum(1))))
    model.save(fitted, f"file://{tmp_path}/m", {"rows": 1})
    assert model.load(spark, f"file://{tmp_path}/m")[1]["rows"] == 1
    assert model.load(spark, f"file://{tmp_path}/none") is None


def test_evaluation(spark):
    got = model.evaluate(extras.training_rows(spark, SF), extras.CONFIG)
    assert 0 <= got["pr_auc"] <= 1 and got["train_rows"] > got["test_rows"] > 0


def test_stream_equals_batch(spark, tmp_path):
    from churnlens.sources import adapter

    touches = adapter.touches(spark, SF).select("path", "sha", "seq", "author", "is_bugfix").where("path LIKE 'pkg1/%'")
    ordered = touches.toPandas().sort_values("seq", kind="stable")
    for i, part in enumerate(np.array_split(np.arange(len(ordered)), 3)):
        spark.createDataFrame(ordered.iloc[part]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    schema = touches.schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = running.running_counts(stream).writeStream.format("memory").queryName("running").option("checkpointLocation", f"{tmp_path}/state").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.table("running").collect()))
    want = sorted(map(tuple, history.running_history(touches).select("path", "sha", "seq", "prior_commits", "prior_fixes").collect()))
    assert got == want


def test_analysis_of_a_branch(spark, repo):
    from churnlens.plans import analysis

    run = lambda *a: subprocess.run(["git", "-C", repo, *a], check=True, capture_output=True)
    run("checkout", "-qb", "topic")
    (repo / "app" / "use.py").write_text("from app import main\nimport app.util\n")
    (repo / "app" / "main.py").write_text("def f(x):\n    return x + 3\n")
    run("add", "-A")
    run("-c", "user.name=Carol", "-c", "user.email=c@example.com", "commit", "-qm", "topic")
    doc = analysis.analyse(spark, str(repo))
    by = {f["path"]: f for f in doc["files"]}
    assert set(by) == {"app/main.py", "app/use.py"} and doc["scope"]["base_ref"] == "main" and doc["scope"]["author"] == "Carol"
    # History ends at the base, where the rename is known; Carol is new to the file.
    assert {r["rule"] for r in by["app/main.py"]["reasons"]} == {"missing_tests", "author_new_to_file"}
    assert {r["rule"] for r in by["app/use.py"]["reasons"]} == {"missing_tests"}
    assert doc["blast_radius"]["analyzed"] and doc["blast_radius"]["direct_count"] == 0 and doc["blast_radius"]["graph"]["edges"] == 2
    per = {p["path"]: p for p in doc["blast_radius"]["per_file"]}
    assert per["app/main.py"]["direct"] == ["app/use.py"]
    assert analysis.analyse(spark, str(repo), "all")["scope"]["files_analyzed"] == 3
    (repo / "app" / "util.py").write_text("import app.main\n")  # not committed: the working tree counts
    doc = analysis.analyse(spark, str(repo), "diff")
    assert [f["path"] for f in doc["files"]] == ["app/util.py"] and doc["blast_radius"]["graph"]["edges"] == 3 and doc["blast_radius"]["direct"] == ["app/use.py"]
    run("checkout", "-q", "--", "app/util.py")
    (repo / "new.py").write_text("a = 1\nb = 2\n")
    assert [(f["path"], f["lines_added"]) for f in analysis.analyse(spark, str(repo), "diff")["files"]] == [("new.py", 2)]


def test_model_takes_over(spark, repo, tmp_path):
    """A saved model scores the change and each file on its own; one of other features is not used, and that is said."""
    from churnlens.plans import analysis

    rows = extras.training_rows(spark, SF)
    saved = f"file://{tmp_path}/model"
    model.save(model.fit(rows, 5, extras.CONFIG), saved, {"rows": 7, "trained_at": "now"})
    doc = analysis.analyse(spark, str(repo), "all", saved=saved)
    assert doc["scoring_method"] == "model" and doc["scope"]["model"]["rows"] == 7 and doc["warnings"] == []
    assert doc["score"] == max(f["score"] for f in doc["files"]) == doc["files"][0]["score"]
    assert all(r["rule"].startswith("model:") and r["detail"].startswith("value ") for r in doc["reasons"])
    model.save(model.fit(rows, 5, extras.CONFIG), saved, {"features": ["other"]})
    doc = analysis.analyse(spark, str(repo), "all", saved=saved)
    assert doc["scoring_method"] == "rules" and len(doc["warnings"]) == 1


def test_complexity_at_the_commit(spark, repo):
    _, touches = gitlog.read_log(spark, str(repo))
    got = gitlog.complexity_then(touches).collect()
    assert got and {r["path"] for r in got} <= {"app/main.py", "app/use.py"} and all(r["max_ccn"] == 1 for r in got)
    records = gitlog.read_records(spark, str(repo))
    stats = gitlog.log_stats(records, max_commits=records.count()).first()
    assert stats["skipped"] == 0 and stats["truncated"]


def test_log_text_in_records(spark, repo, tmp_path):
    (tmp_path / "log.txt").write_text(gitlog.git(str(repo), "log", "--no-merges", "--numstat", gitlog._FORMAT, "HEAD"))
    commits, _ = gitlog.parse_log(gitlog.log_text(spark, str(tmp_path / "log.txt")))
    ours, _ = gitlog.read_log(spark, str(repo))
    order = lambda d: [(r["sha"], r["seq"]) for r in d.orderBy("seq").collect()]
    assert order(commits) == order(ours)
