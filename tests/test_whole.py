"""Registered queries do the whole job: no row of their tables is left out."""

import numpy as np

from churnlens.config import Training
from churnlens.operators import metrics, model
from churnlens.plans import catalogue, extras
from churnlens.plans.storage import cut
from churnlens.sources import adapter

SF = "/root/testdata/sf0.001"


def test_every_path_is_looked_up(spark):
    keys = [r[0] for r in adapter.table(spark, SF, "part").select("p_partkey").collect()]
    moves = sorted(map(tuple, adapter.renames(spark, SF).collect()))
    assert {m[1] for m in moves} >= {f"r{k}/{s}.py" for k in keys for s in "ac"}
    by: dict = {}
    for pos, old, new in moves:
        by.setdefault(old.split("/")[0], []).append((pos, old, new))

    def walk(pos, path):
        today: dict = {}

        def follow(name):
            met = set()
            while name in today and name not in met:
                met.add(name)
                name = today[name]
            return name

        for at, old, new in by[path.split("/")[0]]:
            if at < pos:
                today[old] = follow(new)
        return follow(path)

    got = sorted((r["pos"], r["path"], r["canonical"]) for r in catalogue.queries()["rename_asof"](spark, SF).collect())
    assert got == sorted((k * 3 + 1500, p, walk(k * 3 + 1500, p)) for k in keys for p in (f"r{k}/a.py", f"r{k}/b.py", f"r{k}/c.py"))


def test_every_round_is_evaluated(spark):
    rows, config = cut(extras.training_rows(spark, SF)), Training(max_rounds=20)
    split = cut(metrics.time_split(rows, config.holdout_fraction, "seq", "sha"))
    trees = model.trees_of(spark, model.fit(split.where("is_train"), config.max_rounds, config))
    held = split.where("NOT is_train").toPandas()
    label, sums = held["label"].to_numpy(), np.cumsum(trees.outputs(held[model.NAMES].to_numpy(float)), axis=1)

    def precision(score):
        seen = score[:, None] <= score[None, :]  # column j: what has at least the score of row i
        return np.mean([(label[seen[i]]).mean() for i in np.flatnonzero(label)])

    curve = [precision(sums[:, r]) for r in range(sums.shape[1])]
    assert curve[model.best_rounds(rows, config) - 1] >= max(curve) - 1e-12


def test_growing_fits_find_the_rounds_of_one_long_fit(spark):
    rows = cut(extras.training_rows(spark, SF))
    for patience in (2, 30):
        config = Training(max_rounds=12, patience=patience)
        assert model.best_rounds(rows, config, first=3) == model.best_rounds(rows, config, first=12)


def test_registered_training_is_the_operators(spark, monkeypatch):
    seen = []

    def train(rows, config):
        seen.append((rows.count(), config))
        return None, model.trees_of(spark, model.fit(rows, 2, config))

    monkeypatch.setattr(model, "train", train)
    for name in ("gbt_scores", "shap_topk"):
        assert not catalogue.queries()[name](spark, SF).isEmpty()
    total = extras.training_rows(spark, SF).count()
    assert [c for _, c in seen] == [Training(), Training()] and seen[1][0] == total
