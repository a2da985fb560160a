"""Training rows are made in one pass over the touches."""

from churnlens.operators import features, history
from churnlens.plans import extras
from churnlens.sources import adapter

SF = "/root/testdata/sf0.001"


def test_training_rows_read_the_touches_once_and_are_those_by_name(spark):
    rows = extras.training_rows(spark, SF)
    assert "l_orderkey" not in rows._jdf.queryExecution().executedPlan().toString()  # windows and joins are behind it
    touched = adapter.touches(spark, SF)
    labels = history.labelled(adapter.commits(spark, SF), history.inducing(touched)).select("sha", "seq", "label")
    want = features.feature_vector(history.running_history(touched).join(adapter.complexity(spark, SF), "l_partkey", "left")).join(labels, "sha")
    plain = lambda d: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.select(*sorted(want.columns)).collect())
    assert plain(rows) == plain(want)


def test_rows_are_counted_in_blocks(monkeypatch):
    import tracemalloc

    import numpy as np
    from churnlens.operators import boosting

    n, rnd = 600_000, np.random.default_rng(1)
    cuts = [np.arange(1.0, 30.0)] * 20
    values = [rnd.integers(0, 31, n).astype(float) for _ in cuts]
    data, weight = boosting._Rows(cuts), np.rint(rnd.normal(size=n) * boosting.UNIT) / boosting.UNIT
    data.add(values)
    data.done()
    monkeypatch.setattr(boosting, "BLOCK", 10_000, raising=False)
    rows = np.flatnonzero(values[0] > 3).astype(np.int32)
    tracemalloc.start()
    got = data.count(rows, weight, weight)
    assert tracemalloc.get_traced_memory()[1] < 8 * n  # less than one number a row on the way
    tracemalloc.stop()
    for f, size in enumerate(data.sizes):
        want = np.bincount(np.searchsorted(cuts[f], values[f][rows]), weight[rows], size)
        assert (got[1, data.starts[f] : data.starts[f + 1]] == want).all()
