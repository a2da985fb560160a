"""Quality scores by a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover all of it. Each byte has a
learned vector, learned filters slide over a chunk, and each filter's greatest response in the chunk
is kept (max-pooling). A hidden layer reads a chunk's responses; the mean and the maximum of its units
over all chunks give one probability. The network is trained here, by gradient descent on the whole
texts of a bounded sample of labelled rows (``SAMPLE``); scoring reads whole texts, in bounded
memory, on the executors.

Defined results: a null or empty text is one chunk of padding and gets the network's score of that;
without labels of both kinds every score is the smoothed share of label 1 (0.5 without labels);
labels without a document or without a value are ignored; of repeated labels the smaller counts; a
null id is not held out; repeated rows get a row each; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_texts
from .textvec import as_bytes

#: Labelled rows in the training sample at most.
SAMPLE = 3000
#: Bytes of a chunk and of its step: chunks overlap by more than a filter's width.
CHUNK, STEP = 256, 224
WIDTH, STRIDE, DEPTH, FILTERS, HIDDEN = 6, 2, 6, 32, 16
PLACES = (CHUNK - WIDTH) // STRIDE + 1
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2


def chunks_of(text: bytes) -> np.ndarray:
    """chunks x CHUNK bytes that cover the text; the last is padded with zeros."""
    n = max(1, -(-(len(text) - (CHUNK - STEP)) // STEP))
    padded = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


def initial(seed: int = 5) -> dict[str, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(seed))
    scale = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    return {
        "bytes": (r.standard_normal((256, DEPTH)) * 0.5).astype(np.float32), "filters": scale(WIDTH * DEPTH, FILTERS), "bias": np.zeros(FILTERS, np.float32),
        "hidden": scale(FILTERS, HIDDEN), "hidden_bias": np.zeros(HIDDEN, np.float32), "out": scale(2 * HIDDEN) * 0.5, "out_bias": np.zeros(1, np.float32),
    }


#: Chunks convolved at once.
SLICE = 256


def responses(net: dict, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greatest response of each filter in each chunk, and its place."""
    greatest, places = [], []
    for at in range(0, len(chunks), SLICE):
        vectors = net["bytes"][chunks[at : at + SLICE]]
        windows = np.lib.stride_tricks.sliding_window_view(vectors, WIDTH, axis=1)[:, ::STRIDE].transpose(0, 1, 3, 2)
        conv = (windows.reshape(-1, WIDTH * DEPTH) @ net["filters"]).reshape(len(vectors), PLACES, FILTERS)
        place = conv.argmax(1)
        places.append(place)
        greatest.append(np.take_along_axis(conv, place[:, None], 1)[:, 0])
    return np.concatenate(greatest) + net["bias"], np.concatenate(places)


def _back(net: dict, chunks: np.ndarray, place: np.ndarray, dz: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the filters and byte vectors from those of the greatest responses."""
    filters, vectors = np.zeros_like(net["filters"]), np.zeros_like(net["bytes"])
    for at in range(0, len(chunks), SLICE):
        d, part = dz[at : at + SLICE], chunks[at : at + SLICE]
        spots = part[np.arange(len(part))[:, None, None], place[at : at + SLICE, :, None] * STRIDE + np.arange(WIDTH)]
        filters += np.einsum("cf,cfk->kf", d, net["bytes"][spots].reshape(len(part), FILTERS, WIDTH * DEPTH), optimize=True)
        back = (d[:, :, None] * net["filters"].T[None]).reshape(-1, DEPTH)
        flat = spots.reshape(-1)
        vectors += np.stack([np.bincount(flat, back[:, k], 256) for k in range(DEPTH)], 1).astype(np.float32)
    return {"filters": filters, "bytes": vectors}


def tables(net: dict) -> list[np.ndarray]:
    """What each pair of bytes adds to the filters at each of a window's pairs of places: the convolution as look-ups."""
    each = [net["bytes"] @ net["filters"][j * DEPTH : (j + 1) * DEPTH] for j in range(WIDTH)]
    return [(each[j][None, :, :] + each[j + 1][:, None, :]).reshape(65536, FILTERS) for j in range(0, WIDTH, 2)]


def _pool(net: dict, made: list[np.ndarray], chunks: np.ndarray) -> np.ndarray:
    """chunks x HIDDEN units, a bounded number of chunks at a time."""
    out = []
    for at in range(0, len(chunks), 64):
        pairs = np.ascontiguousarray(chunks[at : at + 64]).view("<u2")
        conv = made[0][pairs[:, :PLACES]]
        for j in range(1, len(made)):
            conv += made[j][pairs[:, j : j + PLACES]]
        z = np.maximum(conv.max(1) + net["bias"], 0)
        out.append(np.maximum(z @ net["hidden"] + net["hidden_bias"], 0))
    return np.concatenate(out)


def score(net: dict, texts: list[bytes], made: list[np.ndarray] | None = None) -> list[float]:
    """Probability of label 1 of each text."""
    made = made or tables(net)
    sets = [chunks_of(t) for t in texts]
    if not sets:
        return []
    units = _pool(net, made, sets[0] if len(sets) == 1 else np.concatenate(sets))
    at = np.cumsum([0, *map(len, sets)])[:-1]
    count = np.array([len(s) for s in sets], np.float32)[:, None]
    joint = np.concatenate([np.add.reduceat(units, at, axis=0) / count, np.maximum.reduceat(units, at, axis=0)], 1)
    logit = joint.astype(np.float64) @ net["out"].astype(np.float64) + float(net["out_bias"][0])
    return (1 / (1 + np.exp(-np.clip(logit, -30, 30)))).tolist()


def train(samples: list[bytes], labels: np.ndarray, steps: int = 400, batch: int = 48, rate: float = 4e-3, seed: int = 5) -> dict[str, np.ndarray]:
    """A network fitted to (text, label) pairs by Adam."""
    net, r = initial(seed), np.random.Generator(np.random.PCG64(seed + 1))
    share = float(np.clip(labels.mean(), 0.01, 0.99))
    net["out_bias"][0] = np.log(share / (1 - share))
    first = {k: np.zeros_like(v) for k, v in net.items()}
    second = {k: np.zeros_like(v) for k, v in net.items()}
    for step in range(1, steps + 1):
        pick = r.choice(len(samples), min(batch, len(samples)), replace=False)
        sets, y = [chunks_of(samples[i]) for i in pick], labels[pick].astype(np.float32)
        chunks, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        count = np.bincount(doc).astype(np.float32)[:, None]
        z0, place = responses(net, chunks)
        z = np.maximum(z0, 0)
        h0 = z @ net["hidden"] + net["hidden_bias"]
        h = np.maximum(h0, 0)
        at = np.cumsum(count[:, 0]).astype(int) - count[:, 0].astype(int)
        mean, top = np.add.reduceat(h, at, axis=0), np.maximum.reduceat(h, at, axis=0)
        joint = np.concatenate([mean / count, top], 1)
        p = 1 / (1 + np.exp(-np.clip(joint @ net["out"] + net["out_bias"], -30, 30)))
        d = (p - y) / len(y)
        g = {"out": joint.T @ d, "out_bias": np.array([d.sum()], np.float32)}
        dj = d[:, None] * net["out"]
        dh = dj[doc, :HIDDEN] / count[doc] + dj[doc, HIDDEN:] * (h == top[doc])
        dh *= h0 > 0
        g["hidden"], g["hidden_bias"] = z.T @ dh, dh.sum(0)
        dz = (dh @ net["hidden"].T) * (z0 > 0)
        g["bias"] = dz.sum(0)
        g |= _back(net, chunks, place, dz)
        fall = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, v in net.items():
            grad = g[k].astype(np.float32) + 1e-4 * v * (k in ("filters", "hidden", "out"))
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad * grad
            v -= fall * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def constant(share: float) -> dict[str, np.ndarray]:
    """A network that gives every text the same probability."""
    net = {k: np.zeros_like(v) for k, v in initial().items()}
    net["out_bias"][0] = np.log(share / (1 - share))
    return net


def held_out(column) -> object:
    """Whether a row is in the fold that training never sees."""
    return F.coalesce(F.pmod(F.crc32(column.cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict[str, np.ndarray]:
    """Trains on labelled rows outside the held-out fold; the sample is chosen by a hash of the id."""
    usable = labels.where(~held_out(F.col(id_col)) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    rows = usable.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    # At most ``sample`` ids and numbers, so the broadcast is bounded whatever the tables hold.
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(rows), "_id")
    got = texts.orderBy(F.xxhash64("_id"), "_id", "_text").limit(sample).toPandas()
    y = got["_label"].to_numpy(np.float32)
    if not len(y) or y.min() == y.max():
        return constant((float(y.sum()) + 1) / (len(y) + 2))
    return train(as_bytes(got["_text"]), y)


def quality_scores(docs: DataFrame, net: dict, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    scored = map_texts(rows, _scorer(net, "score"), "score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _scorer(net: dict, name: str):
    kept: list = []

    def run(texts: list[str]) -> dict[str, list]:
        if not kept:  # once a task
            kept.append(tables(net))
        return {name: score(net, as_bytes(texts), kept[0])}

    return run


def keep_good(docs: DataFrame, net: dict, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows that the classifier accepts; all columns stay."""
    copy, mark = fresh(docs.columns, "_scored_text"), fresh(docs.columns, "_score")
    scored = map_texts(docs.withColumn(copy, F.col(text_col)), _scorer(net, mark), f"`{mark}` double", copy)
    return scored.where(F.col(mark) >= threshold).select(*docs.columns)
