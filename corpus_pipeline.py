"""From raw documents to packed training sequences, in five stages.

Quality classifier, exact dedup, MinHash near-dedup, mixing sources to target weights, packing. Each
stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return
the columns of ``documents``. Between stages the documents are written as Parquet to the shared
folder and read again, so a stage that fails is repeated from its input.

Defined results: a null text counts as empty everywhere; the classifier scores an empty text like any
other, and what it rejects goes; of equal texts one row stays (all empty texts are equal, and of
repeated rows one stays); documents without words are near copies of none; a null id has no near
copies and stays; a null source is a source of its own; a document that the mix takes more than once
is packed more than once, and one that it takes not at all goes; empty tables give an empty result;
further columns go through all stages but packing, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from churnlens.llm import exact_dedup, mixing, near_dedup, packing, quality
from churnlens.llm.common import stored, table

#: Packing's vocabulary and sequence length.
TOKENIZER, LENGTH = "word_bpe_49k.json", 4096


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is trained on the labelled ones."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of texts that are equal without white space."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group linked by a similarity of 0.8 of their five-word shingles."""
    return near_dedup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document, shuffled within shards."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), LENGTH)


STAGES = [("quality", classify), ("exact_dedup", drop_copies), ("near_dedup", drop_near), ("mixing", mix_sources), ("packing", pack)]

#: No SQL expresses the classifier or the tokenizer; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
