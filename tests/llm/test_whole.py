"""Defaults do the whole job on inputs that the given tables lack."""

import random

import numpy as np
import pytest

from churnlens.llm import embedding_dedup, html_text, mixing


def test_default_margin_finds_all_links_of_low_rank_vectors(spark):
    r = np.random.default_rng(7)
    near = r.standard_normal((400, 4))
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    step = r.standard_normal((400, 4))
    x = np.concatenate([near, near + 0.37 * step / np.linalg.norm(step, axis=1, keepdims=True)]) @ np.linalg.qr(r.standard_normal((64, 4)))[0].T
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    unit = embedding_dedup.unit(x)
    links = (unit @ unit.T >= embedding_dedup.THRESHOLD).sum(1) - 1
    got = {q["vec_id"]: q["n_links"] for q in embedding_dedup.embedding_groups(frame, cell_points=50, block=64).collect()}
    assert [got[i] for i in range(len(x))] == links.tolist()


@pytest.mark.parametrize("tag", ['a href="/wiki/hidden-markov"', 'a title="a hidden valley"', 'span style="overflow:hidden"', 'span data-hidden="false"', "a href=/x/hidden", 'a title="x hidden=1 y"', 'a data-class="ad"'])
def test_hidden_is_an_attribute_name_only(tag):
    name = tag.split()[0]
    assert html_text.extract(f"<article><p>one <{tag}>two</{name}> three</p></article>") == "one two three"


@pytest.mark.parametrize("tag", ["span hidden", "span HIDDEN=''", "span class='x' hidden", 'span title="a>b" hidden', "span aria-hidden='true'", "span class=ad"])
def test_hidden_elements_are_left_out(tag):
    assert "two" not in html_text.extract(f"<article><p>one <{tag}>two</span> three</p></article>")


def test_mixing_carries_room_past_a_long_document(spark):
    r = random.Random(4)
    rows = [(i, "w " * r.randint(3, 60), "abc"[i % 3]) for i in range(600)]
    rows += [(1000 + 3 * i + j, "w " * 20_000, "abc"[j]) for i in range(2) for j in range(3)]
    got = mixing.mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string"), shards=4, block_docs=16).collect()
    for s in "abc":
        mine = [x for x in got if "abc"[x["doc_id"] % 3 if x["doc_id"] < 1000 else (x["doc_id"] - 1000) % 3] == s]
        short = mine[0]["target"] - sum(x["taken"] for x in mine)
        full = int(mine[0]["target"] // mine[0]["source_size"])
        # Greedy over whole documents in the order of the blocks, each longest first, as the rule is stated.
        blocks = 2 ** max(0, int(np.ceil(np.log2(len(mine) / 16))))
        frame = spark.createDataFrame([(x["doc_id"],) for x in mine], "doc_id long").selectExpr("doc_id", f"pmod(xxhash64({mixing.SEED}, doc_id), {blocks}) AS b", f"xxhash64({mixing.SEED + 1}, doc_id) AS mix")
        at = {x["doc_id"]: (x["b"], x["mix"]) for x in frame.collect()}
        room, want = int(mine[0]["target"] - full * mine[0]["source_size"] + 1e-6), {}
        for x in sorted(mine, key=lambda x: (at[x["doc_id"]][0], -x["size"], at[x["doc_id"]][1])):
            want[x["doc_id"]] = full + (x["size"] <= room)
            room -= x["size"] * (x["size"] <= room)
        assert {x["doc_id"]: x["repeats"] for x in mine} == want
        assert all(len(x["shards"]) == x["repeats"] for x in mine) and -1e-6 <= short < 1 + room
