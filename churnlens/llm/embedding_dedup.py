"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one representative per group.

Vectors with equal labels and equal components are one point with a weight. Centroids are fitted on
a bounded sample (``SAMPLE`` points); every point is then assigned to its nearest cell, its home. A
point also visits each cell whose bisecting plane is so near that a partner may live behind it: its
gap (cosine to its home centroid less cosine to the other) is at most 0.374 times the distance of the
two centroids. A partner at cosine 0.93 lies at most 0.374 away, so this bound finds every link from
both of its ends, whatever the vectors (``margin=None``); a number is a fixed margin, which may not.

Within a cell, homes and visitors are cut into blocks of ``BLOCK`` points, and a task multiplies two
blocks at a time in double precision. It returns one row per point: the weight of its partners and
its group in this pair of blocks, so no list of pairs is made, and a dense cell spreads over tasks.

Defined results: a null label, a null or zero vector and one with null or non-finite components
link with nothing (n_links 0, own component); vectors of different length are never compared; a null
id has n_links and a null component and is not kept; repeated rows are copies of each other; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, ship, stored
from .components import connected_components

THRESHOLD = 0.93
#: Points that the centroids are fitted on, at most.
SAMPLE = 20_000
#: Points of a label that a cell should hold; cells at most.
CELL_POINTS, MOST_CELLS = 2048, 4096
BLOCK = 2048
#: None: the bound that misses no link.
MARGIN = None


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first, so that squares neither overflow nor vanish."""
    x = np.asarray(vectors, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def spherical_kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """k unit centroids; empty cells are moved to the points worst served."""
    rng = np.random.Generator(np.random.PCG64(seed))
    centroids = points[rng.choice(len(points), k, replace=False)]
    for _ in range(rounds):
        cosine = points @ centroids.T
        cell = cosine.argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, points)
        lengths = np.sqrt((sums * sums).sum(1))
        empty = np.flatnonzero(lengths < 1e-12)
        sums[empty] = points[np.argsort(cosine.max(1))[: len(empty)]]
        lengths[empty] = 1.0
        centroids = sums / np.maximum(lengths, 1e-12)[:, None]
    return centroids


def usable(vector: Column) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & good & F.exists(vector, lambda x: x != 0)


def _assign(centroids: np.ndarray, margin: float | None, threshold: float):
    reach = np.sqrt(2 - 2 * threshold)
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * centroids @ centroids.T))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                vectors = part.column("vector").to_pylist()
                same = np.array([len(v) == centroids.shape[1] for v in vectors], bool)
                cells, homes, rows = [], [], []
                if same.any():
                    cosine = unit(np.array([v for v, s in zip(vectors, same, strict=True) if s])) @ centroids.T
                    home = cosine.argmax(1)
                    gap = cosine[np.arange(len(home)), home][:, None] - cosine
                    visit = gap <= (reach * apart[home] + 1e-9 if margin is None else margin)
                    i, c = np.nonzero(visit)
                    rows, cells, homes = np.flatnonzero(same)[i], c, c == home[i]
                odd = np.flatnonzero(~same)  # of other lengths: one cell for each length
                rows, cells = np.concatenate([rows, odd]).astype(np.int64), np.concatenate([cells, [-len(vectors[j]) - 1 for j in odd]]).astype(np.int64)
                homes = np.concatenate([homes, np.ones(len(odd), bool)]).astype(bool)
                taken = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [taken.column("point"), taken.column("label"), taken.column("weight"), taken.column("vector"), pa.array(cells), pa.array(homes)],
                    names=["point", "label", "weight", "vector", "cell", "home"],
                )

    return run


def _products(threshold: float):
    def run(key, left, right):
        """left: homes of one block; right: points (homes and visitors) of another block."""
        import pandas as pd

        empty = pd.DataFrame({"point": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})
        if not len(left) or not len(right):
            return empty
        a, b = unit(np.array(left["vector"].tolist())), unit(np.array(right["vector"].tolist()))
        ida, idb = left["point"].to_numpy(np.int64), right["point"].to_numpy(np.int64)
        near = (b @ a.T >= threshold) & (idb[:, None] != ida[None, :])
        links = near @ left["weight"].to_numpy(np.int64)
        # Groups of this pair of blocks: labels go back and forth over the links until they rest.
        la, lb = ida.copy(), idb.copy()
        far = np.iinfo(np.int64).max
        while near.any():
            nb = np.minimum(lb, np.where(near, la[None, :], far).min(1))
            na = np.minimum(la, np.where(near, nb[:, None], far).min(0))
            if (na == la).all() and (nb == lb).all():
                break
            la, lb = na, nb
        ends = pd.DataFrame({"point": np.concatenate([idb, ida]), "links": np.concatenate([links, np.zeros(len(ida), np.int64)]), "root": np.concatenate([lb, la])})
        return ends[(ends["links"] > 0) | (ends["root"] != ends["point"])]

    return run


def embedding_groups(
    vectors: DataFrame, threshold: float = THRESHOLD, margin: float | None = MARGIN, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    cell_points: int = CELL_POINTS, block: int = BLOCK,
) -> DataFrame:
    """Per row: vec_id, n_links (other vectors linked directly), component_id, kept (one of each group)."""
    spark = vectors.sparkSession
    ship(spark)
    # Single precision stays single in storage and shuffles, which halves them; products are of doubles all the same.
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast(f"array<{kind}>").alias("vector"))
    rows = rows.withColumn("ok", F.col("label").isNotNull() & F.coalesce(usable(F.col("vector")), F.lit(False)))
    # Copies are told by 128 bits of their components; -0.0 + 0.0 is 0.0.
    plain = F.transform("vector", lambda x: x.cast("double") + F.lit(0.0))
    rows = rows.withColumns({"h1": F.xxhash64(F.lit(1), plain), "h2": F.xxhash64(F.lit(2), plain)})
    rows = stored(rows, "vectors")
    points = rows.where("ok").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight"), F.max("vector").alias("vector"))
    points = stored(points.withColumn("point", F.monotonically_increasing_id()), "points")
    labels, total = points.agg(F.count_distinct("label"), F.count(F.lit(1))).first()
    result = points.select("label", "h1", "h2", "point", "id", "weight")
    if total:
        spread = points.select("vector", F.size("vector").alias("d"), F.xxhash64(F.lit(3), "h1", "h2").alias("mix"))
        dimension = spread.groupBy("d").count().orderBy(F.desc("count"), "d").first()[0]
        sample = spread.where(F.col("d") == dimension).orderBy("mix").select("vector").limit(SAMPLE).toPandas()
        fitted = unit(np.array(sample["vector"].tolist()))
        k = int(min(MOST_CELLS, max(1, -(-total // (labels * cell_points))), len(fitted)))
        label_type = points.schema["label"].dataType.simpleString()
        placed = points.select("point", "label", "weight", "vector").mapInArrow(
            _assign(spherical_kmeans(fitted, k), margin, threshold), f"point long, label {label_type}, weight long, vector array<{kind}>, cell long, home boolean"
        )
        placed = stored(placed, "placed")
        sizes = placed.groupBy("label", "cell").agg(F.ceil(F.count_if("home") / block).cast("long").alias("left_blocks"), F.ceil(F.count(F.lit(1)) / block).cast("long").alias("right_blocks"))
        cut = placed.join(sizes.where("left_blocks > 0"), ["label", "cell"])
        spot = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "point"), F.col(n))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        anew = lambda *names: [F.col(c).alias(c) for c in names]  # noqa: E731  both sides come from one table
        left = cut.where("home").select(*anew("label", "cell"), spot(4, "left_blocks").alias("i"), every("right_blocks").alias("j"), *anew("point", "weight", "vector"))
        right = cut.select(*anew("label", "cell"), every("left_blocks").alias("i"), spot(5, "right_blocks").alias("j"), *anew("point", "vector"))
        by = ["label", "cell", "i", "j"]
        found = stored(left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(_products(threshold), "point long, links long, root long"), "products")
        linked = found.groupBy("point").agg(F.sum("links").alias("links"))
        groups = connected_components(found.select(F.col("point").alias("a"), F.col("root").alias("b")))
        result = result.join(linked, "point", "left").join(groups.withColumnRenamed("id", "point"), "point", "left")
        result = result.withColumn("group", F.coalesce("component", "point"))
        named = result.groupBy("group").agg(F.min("id").alias("component_id"))
        result = result.join(named, "group").select("label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id", F.lit(True).alias("ok"))
    else:
        result = result.select("label", "h1", "h2", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("ok"))
    out = rows.drop("vector").join(result, ["label", "h1", "h2", "ok"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def drop_near_vectors(vectors: DataFrame, **options) -> DataFrame:
    """``vectors`` with one representative of each group; all columns stay."""
    id_col = options.get("id_col", "vec_id")
    name = fresh(vectors.columns, "_gone")
    gone = embedding_groups(vectors, **options).where(~F.col("kept") & F.col("vec_id").isNotNull()).select(F.col("vec_id").alias(name)).distinct()
    return vectors.join(gone, vectors[id_col] == F.col(name), "left_anti")
