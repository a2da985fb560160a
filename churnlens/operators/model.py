"""A gradient-boosted model of the feature vector: training, early stopping on average precision, contributions, storage.

Trees are read from the stored form of a fitted model (a few nodes each, so they fit anywhere) and
applied to rows in Arrow batches for margins of every prefix of the ensemble and exact Shapley values
with the path-dependent value function. The model's log-odds are twice its margin.
"""

from __future__ import annotations

import itertools
import json
import math
import uuid
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RiskWeights, Training
from ..plans.storage import cut, shared_dir, ship, swept, written
from . import boosting, metrics
from .features import FEATURES

NAMES = list(FEATURES)


@dataclass
class Trees:
    """Arrays per tree: feature (-1 at a leaf), threshold, left, right, value, cover; and the trees' weights."""

    trees: list[tuple[np.ndarray, ...]]
    weights: list[float]

    def outputs(self, x: np.ndarray) -> np.ndarray:
        """rows x trees weighted outputs."""
        out, columns = np.empty((len(x), len(self.trees))), np.ascontiguousarray(x.T)
        for t, ((feature, threshold, left, right, value, _), weight) in enumerate(zip(self.trees, self.weights, strict=True)):
            reached = {0: np.arange(len(x))}
            for i in range(len(feature)):
                rows = reached.pop(i)
                if feature[i] < 0:
                    out[rows, t] = value[i] * weight
                else:
                    go = columns[feature[i]][rows] <= threshold[i]
                    reached[left[i]], reached[right[i]] = rows[go], rows[~go]
        return out

    @cached_property
    def shares(self) -> tuple[list[tuple], float]:
        """(inner nodes, features, table of contributions by feature and by the sides taken at the inner nodes as bits) of each tree, and the base value."""
        tables, base = [], 0.0
        for (feature, threshold, left, right, value, cover), weight in zip(self.trees, self.weights, strict=True):
            inner = [int(i) for i in np.flatnonzero(feature >= 0)]
            sides = np.arange(1 << len(inner))
            goes_left = {i: (sides >> k & 1).astype(bool) for k, i in enumerate(inner)}

            def expected(node: int, known: frozenset) -> np.ndarray:
                f = feature[node]
                if f < 0:
                    return np.full(len(sides), value[node])
                a, b = expected(left[node], known), expected(right[node], known)
                if f in known:
                    return np.where(goes_left[node], a, b)
                return (cover[left[node]] * a + cover[right[node]] * b) / cover[node]

            used = sorted({int(feature[i]) for i in inner})
            n = len(used)
            v = {s: expected(0, s) for k in range(n + 1) for s in map(frozenset, itertools.combinations(used, k))}
            base += 2 * weight * float(v[frozenset()][0])
            table = np.zeros((n, len(sides)))
            for j, f in enumerate(used):
                for s, y in v.items():
                    if f not in s:
                        share = math.factorial(len(s)) * math.factorial(n - len(s) - 1) / math.factorial(n)
                        table[j] += 2 * weight * share * (v[s | {f}] - y)
            tables.append(([(int(feature[i]), float(threshold[i])) for i in inner], used, table))
        return tables, base

    def contributions(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """rows x features log-odds contributions and the base value; they add up to the row's log-odds."""
        tables, base = self.shares
        total, columns = np.zeros(x.shape[::-1]), np.ascontiguousarray(x.T)
        for inner, used, table in tables:
            sides = np.zeros(len(x), np.intp)
            for k, (f, threshold) in enumerate(inner):
                sides += (columns[f] <= threshold).astype(np.intp) << k
            for j, f in enumerate(used):
                total[f] += table[j][sides]
        return total.T, base if len(x) else 0.0

    def first(self, rounds: int) -> Trees:
        return Trees(self.trees[:rounds], self.weights[:rounds])


def assemble(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(rows)


def weight_of(rows: DataFrame) -> float:
    """Weight of a positive row: max(1, negatives / positives)."""
    weight = metrics.class_weight(rows).first()[0]
    if weight is None:
        raise ValueError("no positive example to train on")
    return weight


def _grown(rows: DataFrame, rounds: int, config: Training) -> list:
    return boosting.grow(rows, NAMES, rounds, weight_of(rows), config, boosting.borders(rows, NAMES))


def _as_trees(grown: list, config: Training) -> Trees:
    return Trees([boosting.as_arrays(nodes) for nodes in grown], [1.0] + [config.step] * (len(grown) - 1))


def fit(rows: DataFrame, rounds: int, config: Training = Training()) -> GBTClassificationModel:
    """``rows``: the features and a 0/1 label; positives weigh max(1, negatives / positives)."""
    return boosting.as_model(rows.sparkSession, _grown(rows, rounds, config), len(NAMES), config.step)


def trees_of(spark: SparkSession, model: GBTClassificationModel) -> Trees:
    path = f"{shared_dir(spark)}/churnlens-model-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").toPandas()
    out = []
    for _, part in sorted(nodes.groupby("treeID"), key=lambda kv: kv[0]):
        part = part.sort_values("id")
        inner = part["leftChild"].to_numpy() >= 0
        split = [s if ok else None for s, ok in zip(part["split"], inner, strict=True)]
        feature = np.array([int(s["featureIndex"]) if s is not None else -1 for s in split])
        threshold = np.array([float(s["leftCategoriesOrThreshold"][0]) if s is not None else 0.0 for s in split])
        out.append((feature, threshold, part["leftChild"].to_numpy(), part["rightChild"].to_numpy(), part["prediction"].to_numpy(), part["rawCount"].to_numpy().astype(float)))
    return Trees(out, list(model.treeWeights))


def _matrix(frame: pd.DataFrame) -> np.ndarray:
    return frame[NAMES].to_numpy(np.float64)


def predict(rows: DataFrame, fitted: GBTClassificationModel) -> DataFrame:
    """Adds ``probability``, in the JVM."""
    scored = fitted.transform(assemble(rows))
    return scored.select(*rows.columns, vector_to_array("probability")[1].alias("probability"))


#: Rounds that are grown before precision is looked at again.
FIRST_ROUNDS = 64


def _stop(curve: list[float], steps: list[int], patience: int) -> tuple[int, bool]:
    """Rounds of the best value so far, and whether patience ran out within ``curve``."""
    best, since = 0, 0
    for at in range(1, len(curve)):
        if curve[at] > curve[best]:
            best, since = at, 0
        elif (since := since + steps[at] - steps[at - 1]) >= patience:
            return steps[best], True
    return steps[best], False


def best_rounds(train: DataFrame, config: Training = Training(), grid: int = 1, first: int = FIRST_ROUNDS) -> int:
    """Rounds with the best average precision on the newest slice of the training rows, every ``grid`` rounds, with patience.

    Trees are grown ``first`` at a time, each lot on top of those before it, until patience runs out or ``max_rounds`` is reached.
    """
    ship(train.sparkSession)
    split = written(metrics.time_split(train, config.holdout_fraction, "seq", "sha"), "split")
    swept(train.sparkSession)
    fitted, held = split.where("is_train"), split.where("NOT is_train")
    small = split.count() < 10
    both = lambda d: d.agg(F.count_distinct("label")).first()[0] == 2
    if small or not both(fitted) or not both(held):
        return config.max_rounds
    weight, cuts, grown, curve = weight_of(fitted), boosting.borders(fitted, NAMES), [], []
    while True:
        rounds = min(len(grown) + max(first, grid), config.max_rounds)
        grown = boosting.grow(fitted, NAMES, rounds, weight, config, cuts, grown)
        steps = list(range(grid, rounds + 1, grid)) or [rounds]
        curve += _precision_curve(held, _as_trees(grown, config), steps[len(curve) :])
        swept(train.sparkSession)
        best, done = _stop(curve, steps, config.patience)
        if done or rounds == config.max_rounds:
            return best


def _precision_curve(held: DataFrame, trees: Trees, steps: list[int]) -> list[float]:
    """Average precision on ``held`` after each number of rounds in ``steps``; a task ranks the rows once for each."""

    def run(frames):
        for frame in frames:
            sums = np.cumsum(trees.outputs(_matrix(frame)), axis=1)
            label = frame["label"].to_numpy().astype(np.int8).tobytes()
            yield pd.DataFrame({"rounds": steps, "score": [sums[:, s - 1].tobytes() for s in steps], "label": [label] * len(steps)})

    def precision(frame):
        score = np.concatenate([np.frombuffer(b) for b in frame["score"]])
        label = np.concatenate([np.frombuffer(b, np.int8) for b in frame["label"]])
        order = np.argsort(-score)
        last = np.append(np.flatnonzero(np.diff(score[order])), len(order) - 1)  # of each distinct score
        tp = np.cumsum(label[order], dtype=np.int64)[last]
        gained = np.diff(tp, prepend=0)
        return pd.DataFrame({"rounds": frame["rounds"].iloc[:1], "ap": [float(np.sum(gained / tp[-1] * tp / (last + 1)))]})

    scored = held.select(*NAMES, "label").mapInPandas(run, "rounds int, score binary, label binary")
    curve = scored.groupBy("rounds").applyInPandas(precision, "rounds int, ap double").orderBy("rounds").collect()
    return [row["ap"] for row in curve]


def train(rows: DataFrame, config: Training = Training()) -> tuple[GBTClassificationModel, Trees]:
    """Early stopping inside the rows, then a fit on all of them."""
    grown = _grown(rows, best_rounds(rows, config), config)
    return boosting.as_model(rows.sparkSession, grown, len(NAMES), config.step), _as_trees(grown, config)


def contributions(rows: DataFrame, trees: Trees, key: str = "sha", most: int = Training.top_contributions) -> DataFrame:
    """(key, place, feature, impact, value): the features that move a row's log-odds most, none of zero."""
    ship(rows.sparkSession)
    trees.shares  # noqa: B018  once, here, instead of in every task
    names = np.array(NAMES, dtype=object)

    def run(frames):
        for frame in frames:
            values = _matrix(frame)
            impact, _ = trees.contributions(values)
            order = np.argsort(-np.abs(impact), axis=1, kind="stable")[:, :most]
            row, place = np.nonzero(np.take_along_axis(impact, order, axis=1))
            feature = order[row, place]
            yield pd.DataFrame({key: frame[key].to_numpy()[row], "place": place + 1, "feature": names[feature], "impact": impact[row, feature], "value": values[row, feature]})

    return rows.select(key, *NAMES).mapInPandas(run, f"{key} string, place int, feature string, impact double, value double")


def as_scores(predicted: DataFrame, w: RiskWeights = RiskWeights()) -> DataFrame:
    """Adds score (half-even of 100 times the probability) and band."""
    from .rules import band

    return predicted.withColumn("score", F.bround(F.col("probability") * 100, 0).cast("int")).withColumn("band", band(F.col("score"), w))


def evaluate(rows: DataFrame, config: Training = Training()) -> dict:
    """Model and the lines_changed baseline on the newest rows; at least four rows and a positive to train on."""
    split = cut(metrics.time_split(rows, config.train_fraction, "seq", "sha"))
    fitted, held = split.where("is_train").drop("is_train"), split.where("NOT is_train").drop("is_train")
    counts = split.groupBy("is_train").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).collect()
    by = {r["is_train"]: r for r in counts}
    if sum(r["n"] for r in counts) < 4 or not by.get(True) or not by[True]["p"]:
        raise ValueError("too few rows, or no positive one, to evaluate")
    fit_model, _ = train(fitted, config)
    scored = cut(predict(held, fit_model).select("label", F.col("probability").alias("score"), "lines_changed"))
    base = scored.select("label", F.col("lines_changed").alias("score"))
    value = lambda f, d: f(d).first()[0]
    out = {"roc_auc": value(metrics.roc_auc, scored), "pr_auc": value(metrics.pr_auc, scored), "baseline_roc_auc": value(metrics.roc_auc, base), "baseline_pr_auc": value(metrics.pr_auc, base)}
    held_row = by.get(False)
    return out | {"train_rows": by[True]["n"], "test_rows": held_row["n"] if held_row else 0, "base_rate": held_row["p"] / held_row["n"] if held_row else None, "beats_baseline": out["pr_auc"] > out["baseline_pr_auc"]}


def save(model: GBTClassificationModel, path: str, facts: dict) -> None:
    """The model and a JSON sidecar with its feature names and provenance."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps({"features": NAMES} | facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/sidecar")


def load(spark: SparkSession, path: str) -> tuple[GBTClassificationModel | None, dict] | None:
    """(model, facts); no model if it was trained on other features; None if there is none or it can't be read."""
    try:
        facts = json.loads(spark.read.text(f"{path}/sidecar").first()[0])
        return GBTClassificationModel.load(f"{path}/model") if facts.get("features") == NAMES else None, facts
    except Exception:  # noqa: BLE001  whatever is wrong with it, rules take over
        return None
