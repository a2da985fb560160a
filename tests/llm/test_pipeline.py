"""The pipeline's stages, each against a brute-force version on what its predecessor kept."""

import re
from collections import Counter

import corpus_pipeline
from churnlens.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas()
        docs = stored(stage(spark, docs, SF), name)
        after = docs.toPandas()
        seen.append(name)
        if name != "packing":
            assert docs.columns == columns
            assert set(after["doc_id"]) <= set(before["doc_id"])
        if name == "exact_dedup":
            norm = before["text"].map(lambda t: re.sub("[\x20\x09-\x0d]+", "", t or ""))
            assert len(after) == norm.nunique()
        if name == "near_dedup":
            words = {i: re.findall("[^\x20\x09-\x0d]+", (t or "").lower()) for i, t in zip(after["doc_id"], after["text"], strict=True)}
            sets = [frozenset(zip(*(w[j:] for j in range(5)))) for w in words.values() if len(w) >= 5]
            assert all(100 * len(a & b) < 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
        if name == "mixing":
            assert max(Counter(after["doc_id"]).values()) <= 3
            size = lambda d: d["text"].map(lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))).sum()
            assert abs(size(after) - size(before)) <= 0.02 * size(before) + 50
        if name == "packing":
            assert (after.groupby("sequence_id")["length"].sum() <= 4096).all()
            assert set(after["doc_id"]) == set(before["doc_id"])
    assert seen == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert corpus_pipeline.run(spark, SF).count() > 0
