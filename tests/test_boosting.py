"""Boosted trees grown in one stage."""

import numpy as np
from pyspark.ml.classification import GBTClassifier

from churnlens.config import Training
from churnlens.operators import boosting, model
from churnlens.plans import extras
from churnlens.plans.storage import cut

SF = "/root/testdata/sf0.001"


def test_trees_are_those_of_mllib_and_lots_those_of_one_run(spark):
    rows, config = cut(extras.training_rows(spark, SF).select(*model.NAMES, "label").where("files_changed < 20")), Training()
    weight, cuts = model.weight_of(rows), [np.array([1.5, 3.5, 5.5]) if n == "files_changed" else np.array([0.5]) if n == "is_weekend" else np.empty(0) for n in model.NAMES]
    grown = boosting.grow(rows, model.NAMES, 6, weight, config, cuts)
    assert grown == boosting.grow(rows, model.NAMES, 6, weight, config, cuts, boosting.grow(rows, model.NAMES, 2, weight, config, cuts))
    frame = rows.toPandas()
    # MLlib on the same bins: each value is the number of its bin.
    for name, c in zip(model.NAMES, cuts, strict=True):
        frame[name] = np.searchsorted(c, frame[name]).astype(float)
    weighted = model.assemble(spark.createDataFrame(frame.assign(label=frame["label"].astype(float), weight=np.where(frame["label"] == 1, weight, 1.0))))
    theirs = GBTClassifier(maxIter=6, maxDepth=config.depth, stepSize=config.step, minInstancesPerNode=config.min_leaf, weightCol="weight").fit(weighted)
    ours = model.Trees([boosting.as_arrays(t) for t in grown], [1.0] + [config.step] * 5).outputs(rows.toPandas()[model.NAMES].to_numpy(float)).sum(1)
    expected = model.trees_of(spark, theirs).outputs(frame[model.NAMES].to_numpy(float)).sum(1)
    assert np.abs(ours - expected).max() < 1e-5


def test_a_search_grows_every_round_once(spark, monkeypatch):
    asked, grow = [], boosting.grow
    monkeypatch.setattr(boosting, "grow", lambda *a: asked.append(a[2] - len(a[6])) or grow(*a))
    rows, config = cut(extras.training_rows(spark, SF)), Training(max_rounds=12, patience=100)
    model.best_rounds(rows, config, first=3)
    assert sum(asked) == 12


def test_contributions_name_the_largest_and_agree_with_the_margin(spark):
    rows = cut(extras.training_rows(spark, SF))
    trees = model.trees_of(spark, model.fit(rows, 4, Training()))
    frame = rows.toPandas().set_index("sha")
    impact, base = trees.contributions(frame[model.NAMES].to_numpy(float))
    assert np.allclose(impact.sum(1) + base, 2 * trees.outputs(frame[model.NAMES].to_numpy(float)).sum(1))
    got = model.contributions(rows, trees).toPandas()
    for sha, row in list(zip(frame.index, impact, strict=True))[:50]:
        mine = got[got["sha"] == sha].sort_values("place")
        best = [i for i in np.argsort(-np.abs(row), kind="stable")[:6] if row[i] != 0]
        assert list(mine["feature"]) == [model.NAMES[i] for i in best] and np.allclose(mine["impact"], row[best])
    assert len(got)
