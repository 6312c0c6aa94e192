import random
from datetime import datetime, timedelta

import numpy as np

from tallyfield.llm import nearest
from tallyfield.llm.nearest import XFastTrie, nearest_in_time

T0 = datetime(2026, 10, 1, 17)
LEFT = "lid bigint, k string, t timestamp_ntz, gap_us string, bucket int"
RIGHT = "rid bigint, k string, u timestamp_ntz, key string"


def brute(left, right, tol):
    out = {}
    for lid, k, t, *_ in left:
        if k is None or t is None or lid is None:
            continue
        best = min(((abs((t - u) // timedelta(microseconds=1)), rid) for rid, kk, u, _ in right if kk == k and u is not None and rid is not None), default=None)
        if best and best[0] <= tol:
            out[lid] = best[1]
    return out


def run(spark, left, right, tol):
    a, b = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    rows = nearest_in_time(a, b, "k", "t", "u", "lid", "rid", tol).collect()
    assert len({r.lid for r in rows}) == len(rows)
    return {r.lid: r.rid for r in rows}


def make(seed, n, m):
    rnd = random.Random(seed)
    key = lambda: "hot" if rnd.random() < 0.5 else rnd.choice(["a", "b", None, ""])
    at = lambda: None if rnd.random() < 0.05 else T0 + timedelta(microseconds=rnd.choice([rnd.randrange(-10**11, 10**11), 3_600_000_000 * rnd.randrange(-20, 20)]))
    return [(i, key(), at(), "x", 1) for i in range(n)], [(1000 + i, key(), at(), "x") for i in range(m)]


def test_matches_brute_force(spark):
    left, right = make(2, 400, 400)
    for tol in (6 * 3_600_000_000, 0, 1):
        assert run(spark, left + left[:20], right + right[:20], tol) == brute(left, right, tol)


def test_hot_cells_become_grids_and_blocks_are_carried(spark, monkeypatch):
    left, right = make(3, 600, 600)
    monkeypatch.setattr(nearest, "HOT_QUERIES", 7)
    monkeypatch.setattr(nearest, "HOT_LEAVES", 5)
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 11)
    tol = 6 * 3_600_000_000
    assert run(spark, left, right, tol) == brute(left, right, tol)


def test_ties_go_to_the_smaller_identifier_and_the_limit_counts(spark):
    h = timedelta(hours=1)
    left = [(1, "a", T0, "", 0), (2, "b", T0, "", 0), (3, "c", T0, "", 0)]
    right = [(9, "a", T0 + h, ""), (8, "a", T0 - h, ""), (7, "b", T0 + 6 * h, ""), (6, "c", T0 + 6 * h + timedelta(microseconds=1), ""), (5, "b", T0 + 6 * h, "")]
    assert run(spark, left, right, 6 * 3_600_000_000) == {1: 8, 2: 5}


def test_empty_tables(spark):
    left, right = make(4, 5, 5)
    assert run(spark, [], right, 10) == {} and run(spark, left, [], 10) == {}


def test_trie_neighbours_by_group():
    width = 6
    leaves = np.array([(1 << width) | 3, (1 << width) | 40, (2 << width) | 10])
    pred, succ = XFastTrie(leaves, width).neighbours(np.array([(1 << width) | 3, (1 << width) | 20, (1 << width) | 63, (2 << width) | 0, (3 << width) | 5]))
    assert pred.tolist() == [0, 0, 1, -1, -1] and succ.tolist() == [0, 1, -1, 2, -1]
