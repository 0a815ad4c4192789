from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicspan.llm.topk import integers, top_k, usable


def by_hand(rows, is_query, k):
    out = []
    for q, a in rows:
        if is_query(q):
            scores = sorted((-int(sum(x * y for x, y in zip(a, b, strict=False))), i) for i, b in rows if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("spread", [20, 3, 40_000, 300_000_000])
def test_equals_comparing_all(spark, spread):
    rng = np.random.default_rng(spread)
    centres = rng.integers(-spread, spread + 1, (5, 8))
    rows = [(i, (centres[i % 5] + rng.integers(-spread // 3, spread // 3 + 1, 8)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(150)]  # a very common vector
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    got = sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert got == by_hand(rows, lambda i: i % 50 == 0, 5)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.25]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (50, [1.0, -1.0]), (5, [0.5]), (5, [0.5]), (6, []), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS score", "2 AS rank", "3 AS v")
    part = df.where(usable(F.col("embedding"))).select("vec_id", integers(F.col("embedding")).alias("vector"), "score", "v")
    got = sorted(tuple(r) for r in top_k(part, F.col("vec_id") % 50 == 0).collect())
    kept = [(0, [128, 64]), (5, [128]), (6, []), (50, [256, -256])]
    assert got == by_hand(kept, lambda i: i % 50 == 0, 5)
    assert top_k(part.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert top_k(part.where("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0
