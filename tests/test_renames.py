"""Renames are followed family by family."""

import random

from churnlens.operators import renames


def test_families_are_the_connected_groups(spark):
    rnd = random.Random(5)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(140)] + [(n, n + 1) for n in range(1000, 1060)] + [(2000, n) for n in range(2001, 2050)]
    root: dict = {}

    def find(n):
        while root.setdefault(n, n) != n:
            n = root[n]
        return n

    for a, b in links:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = [tuple(r) for r in renames.families(spark.createDataFrame(links, "a long, b long")).collect()]
    assert sorted(got) == sorted((n, find(n)) for n in root)


def test_every_row_of_the_touches_stays(spark):
    moves = [(n * 2, f"f{n // 50}/{n % 50 + 1}", f"f{n // 50}/{n % 50}") for n in range(200)]  # chains of 50
    touches = [(1000, "f0/50", 1), (1000, "f0/50", 2), (1000, "f0/50", 2), (49, "f0/50", 3), (51, "f0/3", 4), (5, None, 5), (None, "f0/3", 6), (1000, "f9/1", 7)]
    got = renames.canonical_paths(spark.createDataFrame(touches, "pos long, path string, old_path int"), spark.createDataFrame(moves, "pos long, old_path string, new_path string"))
    want = [(*touches[0], "f0/0"), (*touches[1], "f0/0"), (*touches[2], "f0/0"), (*touches[3], "f0/50"), (*touches[4], "f0/0"), *((*t, t[1]) for t in touches[5:])]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_a_walk_is_dealt_by_family_and_joins_no_rows_back(spark):
    got = renames.canonical_paths(spark.range(9).selectExpr("id AS pos", "concat('a', id % 3) AS path"), spark.createDataFrame([(1, "a0", "b0"), (2, "a1", "b1")], "pos long, old_path string, new_path string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_family" in plan and "InPandas" not in plan
