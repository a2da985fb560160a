"""Token counts through a digest cache.

Stored counts are keyed by (SHA-256 of the content, digest of the tokenizer file). Contents that the
cache lacks are reduced to distinct ones, encoded once, and appended; every document then takes its
count from the cache by an equi-join. The content is normalised only as far as counts allow: null
becomes the empty text, and the bytes stay as they are.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows each get a row; a null
``doc_id`` is carried on; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import ByteCounts, made
from .common import scratch_path, ship, stored

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Names a version of a tokenizer: any change of the file changes it."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:32]


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The cache's rows; a folder that isn't there yet is an empty cache."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(cache)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache)


def _counter(path: str):
    if path.endswith(".json"):
        return made(ByteCounts, path).count
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda text: len(model.encode(text))


def _encode_distinct(path: str, version: str):
    """Counts of the first row of each digest in a partition; all rows of a digest are in one partition."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, seen = _counter(path), set()
        for frame in frames:
            digests, counts = [], []
            for digest, text in zip(frame["digest"], frame["content"], strict=True):
                if digest not in seen:
                    seen.add(digest)
                    digests.append(digest)
                    counts.append(count(text))
            yield pd.DataFrame({"digest": digests, "tokenizer": version, "n_tokens": counts})

    return run


def _first_of_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Drops copies that one task sees, so that a hot text is sent once a task."""
    seen: set[bytes] = set()
    for frame in frames:
        keep = []
        for digest in frame["digest"]:
            keep.append(digest not in seen)
            seen.add(digest)
        yield frame[keep]


def token_counts(
    docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    ``tokenizer``: a file of the library ``tokenizers`` (.json) or ``sentencepiece`` (.model).
    ``cache``: a Parquet folder that all executors share; without one it lasts for this call.
    """
    spark = docs.sparkSession
    ship(spark)
    version = tokenizer_digest(tokenizer)
    cache = cache or scratch_path(spark, "token-cache")
    text = F.coalesce(F.col(text_col), F.lit(""))
    content = docs.select(F.col(id_col).alias("doc_id"), text.alias("content"))
    digest = F.unhex(F.sha2("content", 256))
    rows = stored(content.select("doc_id", digest.alias("digest"), F.octet_length("content").cast("long").alias("n_bytes")), "contents")
    known = read_cache(spark, cache).where(F.col("tokenizer") == version).select("digest")
    misses = rows.select("digest").distinct().join(known, "digest", "left_anti")
    if not misses.isEmpty():
        texts = content.select(digest.alias("digest"), "content").mapInPandas(_first_of_task, "digest binary, content string")
        if not known.isEmpty():  # else every digest is a miss
            texts = texts.join(misses, "digest", "left_semi")
        width = int(spark.conf.get("spark.sql.shuffle.partitions"))
        new = texts.repartition(width, "digest").mapInPandas(_encode_distinct(tokenizer, version), CACHE_SCHEMA)
        new.write.mode("append").parquet(cache)
    counted = read_cache(spark, cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return rows.join(counted, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
