from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from potluck.llm import topk_search as S
from potluck.llm.topk_search import Block, top_k


def brute(rows, k=10, every=100):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in good:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows],
                                 "vec_id long, embedding array<float>, block int, dims string, v int").repartition(3)


def result(df):
    return {tuple(r) for r in df.collect()}


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 100)
    monkeypatch.setattr(S, "QUERIES", 3)
    rng = random.Random(1)
    rows = [(i * 7, [float(np.float32(rng.gauss(0, .3))) for _ in range(8)]) for i in range(600)]
    rows += [(10_000 + i, rows[i][1]) for i in range(60)]                     # ties
    assert result(top_k(table(spark, rows), F.col("id") % 100 == 0)) == brute(rows)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (100, None), (200, []), (300, [nan, 1.0]), (400, [1.0, None]), (500, [inf, 0.0]),
            (600, [0.0, 0.0]), (None, [1.0, 1.0]), (1, [0.5, -0.5]), (2, [0.5, -0.5]), (3, [1.0]), (700, [-1.0, 0.25])]
    got = result(top_k(table(spark, rows), F.col("id") % 100 == 0))
    assert got == brute(rows)
    assert top_k(table(spark, []), F.col("id") % 100 == 0).collect() == []
    repeated = result(top_k(table(spark, [(100, [1.0]), (100, [1.0]), (1, [2.0]), (2, [3.0])]), F.col("id") % 100 == 0))
    assert repeated == {(100, 1, 2, 3 * 1024 * 1024), (100, 2, 1, 2 * 1024 * 1024)}
    # query rows that share an id but not a vector: each with its own ranks
    apart = top_k(table(spark, [(100, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [3.0, 1.0]), (2, [2.0, 4.0])]), F.col("id") % 100 == 0)
    m = 1024 * 1024
    assert sorted(map(tuple, apart.collect())) == [(100, 1, 1, 3 * m), (100, 1, 2, 4 * m), (100, 2, 1, m), (100, 2, 2, 2 * m)]


def test_search_stops_early():
    rng = np.random.default_rng(0)
    vectors = rng.integers(-50, 50, (5000, 3))
    vectors[:12] = [[900, 900, 900]] * 12
    block = Block(np.arange(5000), vectors)
    walked = []

    class Counting(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, slice):
                walked.append(at)
            return super().__getitem__(at)
    block.lists = block.lists.view(Counting)
    ids, scores = block.search(-1, np.array([5, 5, 5]), 10)
    assert ids.tolist() == list(range(10)) and scores[0] == 13_500
    assert max(w.stop for w in walked if w.stop) <= 5000 and len(walked) == 2
