"""Boosted trees of depth ``config.depth``, grown by all cores together.

The algorithm is MLlib's for binary labels: at most 32 bins a feature, a first tree of the labels (-1, 1) and then
trees of the residuals of the log-loss, splits by reduction of weighted variance. Rows are binned once and stay in
the tasks of one barrier stage, which add up their histograms over sockets, so a round costs no Spark job. Of two
siblings only the smaller is counted. Residuals are rounded to multiples of 2^-20: sums are exact, and the trees are the
same however the rows are dealt out.
"""

from __future__ import annotations

import json
import pickle
import socket
import struct
import uuid

import numpy as np
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Training
from ..plans.storage import ship

#: Bins of a feature, and rows (by a hash of their features) at which the borders of bins are read; all rows are trained on.
BINS, BORDER_ROWS = 32, 100_000
#: Residuals are multiples of 1 / UNIT. Counts of positive rows are added up as multiples of PAIR beside those of the others.
UNIT, PAIR = 2.0**20, 2.0**26
#: Bins of features that are counted together.
JOINT = 1 << 15
#: Rows that are counted, or whose residuals are made, at once: what is made on the way stays small.
BLOCK = 1 << 18
DIGITS = 9


def borders(rows: DataFrame, names: list[str]) -> list[np.ndarray]:
    """Thresholds per feature, between distinct values, so that each bin has about as many rows as the others."""
    n, steps = rows.count(), 1 << 20
    some = rows.select(*(F.col(c).cast("double") for c in names))
    if n > BORDER_ROWS:
        some = some.where(F.pmod(F.xxhash64(*(F.floor(F.col(c) * 1e6 + 0.5) for c in names)), F.lit(steps)) < max(1, steps * BORDER_ROWS // n))
    frame, out = some.toPandas(), []
    for c in names:
        values, counts = np.unique(frame[c].to_numpy(np.float64).round(DIGITS), return_counts=True)
        middle = (values[:-1] + values[1:]) / 2
        if len(middle) >= BINS:
            upto, picked, room = np.cumsum(counts), [], counts.sum() / BINS
            target = room
            for i in range(len(middle)):
                # The border nearest to the target, as the running count passes it.
                if upto[i + 1] > target and len(picked) < BINS - 1:
                    nearer = target - upto[i] <= upto[i + 1] - target
                    picked.append(i if nearer else i + 1)
                    while target < upto[picked[-1]] + room / 2:
                        target += room
            middle = middle[sorted({i for i in picked if i < len(middle)})]
        out.append(middle)
    return out


class _Sum:
    """Adds arrays over the tasks of a barrier stage; task 0 adds them in the order of tasks."""

    def __init__(self, context):
        self.rank, tasks = context.partitionId(), len(context.getTaskInfos())
        self.peers: list[socket.socket] = []
        host = context.getTaskInfos()[0].address.rsplit(":", 1)[0]
        if tasks == 1:
            return
        server = socket.create_server((host, 0), backlog=tasks) if self.rank == 0 else None
        mine = json.dumps([server.getsockname()[1], uuid.uuid4().hex]) if server else ""
        port, token = json.loads(context.allGather(mine)[0])
        if server:
            server.settimeout(300)
            found = {}
            while len(found) < tasks - 1:
                peer = server.accept()[0]
                peer.settimeout(3600)
                if self._read(peer, 32) == token.encode():
                    found[struct.unpack("<i", self._read(peer, 4))[0]] = peer
            server.close()
            self.peers = [found[r] for r in sorted(found)]
        else:
            self.peers = [socket.create_connection((host, port), timeout=3600)]
            self.peers[0].sendall(token.encode() + struct.pack("<i", self.rank))
        for peer in self.peers:
            peer.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    @staticmethod
    def _read(peer: socket.socket, size: int) -> bytes:
        got = bytearray()
        while len(got) < size:
            more = peer.recv(min(size - len(got), 1 << 20))
            if not more:
                raise ConnectionError("a task of the training stage ended")
            got += more
        return bytes(got)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        if not self.peers:
            return values
        if self.rank:
            self.peers[0].sendall(values.tobytes())
            return np.frombuffer(self._read(self.peers[0], values.nbytes)).reshape(values.shape)
        total = values.copy()
        for peer in self.peers:
            total += np.frombuffer(self._read(peer, values.nbytes)).reshape(values.shape)
        for peer in self.peers:
            peer.sendall(total.tobytes())
        return total


class _Rows:
    """A task's rows as bins; several features share an index, so that one count serves them all."""

    def __init__(self, cuts: list[np.ndarray]):
        self.cuts, self.sizes = cuts, [len(c) + 1 for c in cuts]
        self.groups: list[list[int]] = [[]]
        for f, size in enumerate(self.sizes):
            if self.groups[-1] and size * np.prod([self.sizes[g] for g in self.groups[-1]]) > JOINT:
                self.groups.append([])
            self.groups[-1].append(f)
        self.place = {f: (g, int(np.prod([self.sizes[x] for x in group[i + 1 :]], dtype=int))) for g, group in enumerate(self.groups) for i, f in enumerate(group)}
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.parts: list[list[np.ndarray]] = [[] for _ in self.groups]

    def add(self, columns: list[np.ndarray]) -> None:
        for g, group in enumerate(self.groups):
            index = np.zeros(len(columns[0]), np.int64)
            for f in group:
                index = index * self.sizes[f] + np.searchsorted(self.cuts[f], columns[f])
            self.parts[g].append(index.astype(np.uint16))

    def done(self) -> None:
        self.index = [np.concatenate(p) if p else np.empty(0, np.uint16) for p in self.parts]
        del self.parts

    def count(self, rows: np.ndarray | None, *weights: np.ndarray) -> np.ndarray:
        """weights x all bins of all features: sums over ``rows``."""
        out = np.empty((len(weights), self.starts[-1]))
        shapes = [[self.sizes[f] for f in group] for group in self.groups]
        joints = [np.zeros((len(weights), int(np.prod(shape)))) for shape in shapes]
        n = len(self.index[0]) if rows is None else len(rows)
        for low in range(0, n, BLOCK):
            some = slice(low, low + BLOCK) if rows is None else rows[low : low + BLOCK]
            taken = [w[some] for w in weights]
            for index, joint in zip(self.index, joints, strict=True):
                at = index[some].astype(np.intp)
                for k, weight in enumerate(taken):
                    joint[k] += np.bincount(at, weight, joint.shape[1])
        for group, shape, joint in zip(self.groups, shapes, joints, strict=True):
            for i, f in enumerate(group):
                out[:, self.starts[f] : self.starts[f + 1]] = joint.reshape(-1, *shape).sum(axis=tuple(j + 1 for j in range(len(group)) if j != i))
        return out

    def left(self, rows: np.ndarray | None, feature: int, last: int) -> np.ndarray:
        group, stride = self.place[feature]
        index = self.index[group] if rows is None else self.index[group][rows]
        return index // np.uint16(stride) % np.uint16(self.sizes[feature]) <= last


def _best(hist: np.ndarray, data: _Rows, weight: float, least: int):
    """(gain, feature, last bin on the left) of a node, or None; ``hist``: sums of residuals, positive and other rows per bin."""
    best = None
    for f, size in enumerate(data.sizes):
        if size < 2:
            continue
        s, pos, neg = np.cumsum(hist[:, data.starts[f] : data.starts[f + 1]], axis=1)
        n, w = pos + neg, neg + weight * pos
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (s[:-1] ** 2 / w[:-1] + (s[-1] - s[:-1]) ** 2 / (w[-1] - w[:-1]) - s[-1] ** 2 / w[-1]) / w[-1]
        gain = np.where((n[:-1] >= least) & (n[-1] - n[:-1] >= least) & (n[:-1] > 0) & (n[-1] > n[:-1]), gain, -1.0)
        at = int(np.argmax(gain))
        if gain[at] > 1e-12 and (best is None or gain[at] > best[0]):
            best = (float(gain[at]), f, at)
    return best


def _tree(data: _Rows, residual: np.ndarray, counts: np.ndarray, root: np.ndarray, add: _Sum, weight: float, config: Training):
    """(nodes, (rows, value) of each leaf); a node: gain, feature, threshold, left, right, value, cover, in pre-order."""
    first = np.concatenate([add(data.count(None, residual)), root])
    made: dict[int, tuple] = {}
    level = [(1, None, first)]
    while level:
        parents, small = [], []
        for node, rows, hist in level:
            s, pos, neg = hist[:, data.starts[0] : data.starts[1]].sum(axis=1)
            found = _best(hist, data, weight, config.min_leaf) if node < 1 << config.depth else None
            made[node] = (found, s / (neg + weight * pos) if pos + neg else 0.0, pos + neg, rows)
            if not found:
                continue
            _, f, last = found
            low = hist[1:, data.starts[f] : data.starts[f] + last + 1].sum()
            left = data.left(rows, f, last)
            sides = [np.flatnonzero(left).astype(np.int32), np.flatnonzero(~left).astype(np.int32)] if rows is None else [rows[left], rows[~left]]
            few = 0 if 2 * low <= pos + neg else 1
            parents.append((node, sides, few, hist))
            if 2 * node < 1 << config.depth:
                sums, both = data.count(sides[few], residual, counts)
                small.append(np.stack([sums, both // PAIR, both % PAIR]))
            else:  # leaves need their totals only
                part = hist[:, data.starts[f] : data.starts[f + 1]]
                of = [part[:, : last + 1].sum(axis=1), part[:, last + 1 :].sum(axis=1)]
                for k in (0, 1):
                    made[2 * node + k] = (None, of[k][0] / (of[k][2] + weight * of[k][1]), of[k][1] + of[k][2], sides[k])
        total = add(np.stack(small)) if small else []
        level = []
        for (node, sides, few, hist), less in zip(parents, total, strict=False):
            of = [less, hist - less] if few == 0 else [hist - less, less]
            level += [(2 * node + k, sides[k], of[k]) for k in (0, 1)]
    order: list[int] = []

    def walk(node):
        order.append(node)
        if made[node][0]:
            walk(2 * node)
            walk(2 * node + 1)

    walk(1)
    at = {node: i for i, node in enumerate(order)}
    nodes = [(*((g, f, float(data.cuts[f][last]), at[2 * node], at[2 * node + 1]) if (found := made[node][0]) and (g := found[0]) and ((f := found[1]) >= 0) and ((last := found[2]) >= 0) else (-1.0, -1, 0.0, -1, -1)), float(made[node][1]), float(made[node][2])) for node in order]
    return nodes, [(made[node][3], made[node][1]) for node in order if not made[node][0]]


def as_arrays(nodes: list[tuple]):
    gain, feature, threshold, left, right, value, cover = zip(*nodes, strict=True)
    return np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(cover)


def grow(rows: DataFrame, names: list[str], rounds: int, weight: float, config: Training, cuts: list[np.ndarray], before: list | None = None) -> list[list[tuple]]:
    """The trees ``before`` and those of the rounds after them, up to ``rounds``, as lists of nodes."""
    spark, before = rows.sparkSession, before or []
    ship(spark)

    def run(batches):
        from pyspark import BarrierTaskContext

        data, labels = _Rows(cuts), []
        for batch in batches:
            data.add([batch.column(c).to_numpy(zero_copy_only=False).round(DIGITS) for c in names])
            labels.append(batch.column("label").to_numpy(zero_copy_only=False) == 1)
        data.done()
        positive = np.concatenate(labels) if labels else np.empty(0, bool)
        context = BarrierTaskContext.get()
        add = _Sum(context)
        counts = np.where(positive, PAIR, 1.0)
        both = data.count(None, counts)[0]
        root = add(np.stack([both // PAIR, both % PAIR]))
        margin, residual, trees = np.zeros(len(counts)), np.empty(len(counts)), list(before)
        for t, nodes in enumerate(before):
            reached = {0: np.arange(len(counts), dtype=np.int32)}
            for i, (_, f, threshold, left, right, value, _) in enumerate(nodes):
                mine = reached.pop(i)
                if f < 0:
                    margin[mine] += (config.step if t else 1.0) * value
                else:
                    go = data.left(mine, f, int(np.searchsorted(cuts[f], threshold)))
                    reached[left], reached[right] = mine[go], mine[~go]
        while len(trees) < rounds:
            for low in range(0, len(counts), BLOCK):
                some = slice(low, low + BLOCK)
                sign = np.where(positive[some], 1.0, -1.0)
                aim = 4.0 * sign / (1.0 + np.exp(2.0 * sign * margin[some])) if trees else sign
                residual[some] = np.rint(aim * (np.where(positive[some], weight, 1.0) * UNIT)) / UNIT
            nodes, leaves = _tree(data, residual, counts, root, add, weight, config)
            for mine, value in leaves:
                if mine is None:
                    margin += (config.step if trees else 1.0) * value
                else:
                    margin[mine] += (config.step if trees else 1.0) * value
            trees.append(nodes)
        import pyarrow as pa

        context.barrier()
        yield pa.RecordBatch.from_pydict({"trees": [pickle.dumps(trees)] if add.rank == 0 else pa.array([], pa.binary())})

    typed = rows.select(*(F.col(c).cast("double").alias(c) for c in names), F.col("label").cast("int").alias("label"))
    grown = typed.repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "trees binary", barrier=True)
    return pickle.loads(grown.collect()[0][0])


def as_model(spark: SparkSession, trees: list[list[tuple]], features: int, step: float) -> GBTClassificationModel:
    """MLlib's model of these trees, which predicts in the JVM and is stored in its format."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    ml, calculator = jvm.org.apache.spark.ml, jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator

    def node(nodes, i):
        gain, f, threshold, left, right, value, cover = nodes[i]
        stats = gateway.new_array(jvm.double, 3)
        stats[0], stats[1], stats[2] = cover, cover * value, cover * value * value
        seen = calculator(stats, int(cover))
        if f < 0:
            return ml.tree.LeafNode(value, 0.0, seen)
        return ml.tree.InternalNode(value, 0.0, gain, node(nodes, left), node(nodes, right), ml.tree.ContinuousSplit(f, threshold), seen)

    regression = ml.regression.DecisionTreeRegressionModel
    of, weights = gateway.new_array(regression, len(trees)), gateway.new_array(jvm.double, len(trees))
    for t, nodes in enumerate(trees):
        of[t], weights[t] = regression(f"dtr_{uuid.uuid4().hex[:12]}", node(nodes, 0), features), step if t else 1.0
    return GBTClassificationModel(ml.classification.GBTClassificationModel(f"GBTClassifier_{uuid.uuid4().hex[:12]}", of, weights))
