import random
from collections import defaultdict

import numpy as np
import pytest

from lectern.llm.packing import OpenContainers, fill, pack, pack_shard

BUDGETS = [(1, 50, 2), (2, 200, 0)]


def test_best_fit_and_fullest_closes_first():
    box = OpenContainers(10, 2)
    assert [box.put(s) for s in (6, 5, 4, 5)] == [0, 1, 0, 1]
    box = OpenContainers(10, 2)
    assert box.put(7) == 0 and box.put(6) == 1
    assert box.put(8) == 2  # nothing fits; the fullest, 0, is closed
    assert box.put(3) == 1 and box.put(2) == 2


def test_against_a_list_of_open_containers():
    rng = random.Random(4)
    sizes = [rng.randrange(1, 60) for _ in range(2000)]
    box, got = OpenContainers(60, 7), []
    open_bins, made, want = {}, 0, []
    for s in sizes:
        got.append(box.put(s))
        fitting = [(free, n) for n, free in open_bins.items() if free >= s]
        if fitting:
            free = min(f for f, _ in fitting)
            n = next(n for n in open_bins if open_bins[n] == free)
            open_bins.pop(n)
        else:
            if len(open_bins) == 7:
                fullest = min(open_bins.values())
                open_bins.pop(next(n for n in open_bins if open_bins[n] == fullest))
            n, free, made = made, 60, made + 1
        want.append(n)
        if free > s:
            open_bins[n] = free - s
    assert got == want


def test_shard_divides_only_oversized():
    item, piece, first, tokens, container = pack_shard(np.array([10, 48, 49, 120]), 50, 2, 4)
    parts = defaultdict(list)
    for i, p, f, t in zip(item, piece, first, tokens):
        parts[int(i)].append((int(p), int(f), int(t)))
    assert parts[0] == [(1, 0, 10)] and parts[1] == [(1, 0, 48)]
    assert parts[2] == [(1, 0, 48), (2, 48, 1)] and [t for *_, t in parts[3]] == [48, 48, 24]


def test_operator(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(1, 120), "x") for i in range(400)] + [(7, 5, "x"), (7, 5, "x"), (None, 5, "x"), (500, None, "x"), (501, 0, "x"), (502, -3, "x")]
    df = spark.createDataFrame(rows, "doc_id long, tokens int, container string")
    placed = pack(df, BUDGETS, "doc_id", shards=3, places=8)
    out = placed.collect()
    for budget, capacity, separator in BUDGETS:
        own = [r for r in out if r.budget_id == budget]
        assert sum(r.tokens for r in own) == sum(t for _, t, _ in rows if t and t > 0)
        used = defaultdict(int)
        for r in own:
            used[r.container] += r.tokens + separator
        assert max(used.values()) <= capacity
        assert {r.doc_id for r in own if r.piece_no > 1} <= {d for d, t, _ in rows if t and t + separator > capacity}
    shares = {r.budget_id: r.filled for r in fill(placed, BUDGETS).collect()}
    assert min(shares.values()) > 0.85
    again = pack(df.repartition(7), BUDGETS, "doc_id", shards=3, places=8).collect()
    assert sorted(map(tuple, (r for r in again)), key=str) == sorted(map(tuple, (r for r in out)), key=str)


def test_edges(spark):
    df = spark.createDataFrame([], "doc_id long, tokens long")
    assert pack(df, BUDGETS, "doc_id").count() == 0
    assert pack(spark.createDataFrame([(1, 5)], "doc_id long, tokens long"), [], "doc_id").count() == 0
    with pytest.raises(ValueError):
        pack(df, [(1, 3, 3)], "doc_id")
