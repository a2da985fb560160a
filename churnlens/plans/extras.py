"""Queries that SQL can't express; their tests compare them with direct computations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Training
from ..operators import features, history, model, rules
from ..sources import adapter
from . import payload
from .storage import swept, written

CONFIG = Training()


def training_rows(spark, sf) -> DataFrame:
    """Features and label of every commit with touches. Touches are joined and ordered by path once, with keys for names, for history, complexity and labels alike."""
    run = history.running_history(adapter.keyed_touches(spark, sf)).withColumn("last", F.when(F.col("is_bugfix"), history.last_before()))
    known = adapter.complexity(spark, sf).withColumnRenamed("l_partkey", "path")
    run = written(run.join(known, "path", "left").drop("author", "is_bugfix"), "running")
    swept(spark)
    bad = run.select("last.seq", "last.sha").where("sha IS NOT NULL").distinct().withColumn("label", F.lit(1))
    rows = run.drop("last").repartition("seq", "sha").withColumn("path", adapter.path_of("path"))
    rows = features.feature_vector(rows, "seq", "sha").join(bad, ["seq", "sha"], "left")
    return rows.withColumns({"sha": F.col("sha").cast("string"), "label": F.coalesce("label", F.lit(0))})


def _stored(spark, rows: DataFrame, name: str) -> DataFrame:
    rows = written(rows, name)
    swept(spark)
    return rows


def gbt_scores(spark, sf):
    """Probabilities of the newest quarter by a model trained on the rest."""
    from ..operators.metrics import time_split

    # Written first: the split reads its rows three times.
    split = _stored(spark, time_split(_stored(spark, training_rows(spark, sf), "rows"), CONFIG.train_fraction, "seq", "sha"), "split")
    fitted, _ = model.train(split.where("is_train").drop("is_train"), CONFIG)
    return model.as_scores(model.predict(split.where("NOT is_train").drop("is_train"), fitted)).select("sha", "label", "probability", "score", "band")


def shap_topk(spark, sf):
    rows = _stored(spark, training_rows(spark, sf), "rows")
    _, trees = model.train(rows, CONFIG)
    return model.contributions(rows, trees).drop("value")


def payload_json(spark, sf):
    from .catalogue import scored_files

    return payload.payloads(rules.score_changes(scored_files(spark, sf)))


def queries() -> dict:
    return {f.__name__: f for f in (gbt_scores, shap_topk, payload_json)}
