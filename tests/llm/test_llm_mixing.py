from __future__ import annotations

import random

import pytest
from helpers import edge_docs, empty_docs
from pyspark.sql import functions as F

from topicspan.llm.common import word_count
from topicspan.llm.mixing import mix, mixed_documents, source_targets


def targets_by_hand(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        free -= over
    return target


def rows_of(spark, sizes):
    return spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_resharing_by_hand(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 3, 50, 1000, 70_000]) for i in range(rng.choice([1, 4, 9]))}
    sizes[None] = rng.randrange(500)
    got = {r["source"]: r["target"] for r in source_targets(rows_of(spark, sizes)).collect()}
    want = targets_by_hand(sizes)
    assert got.keys() == want.keys()
    assert all(got[s] == pytest.approx(want[s]) for s in want)


def test_mix_takes_each_budget_to_the_word(spark):
    rng = random.Random(5)
    data = [(i, "hot" if i % 3 == 0 else f"s{i % 5}", rng.randrange(200)) for i in range(2000)]
    rows = spark.createDataFrame(data, "id long, source string, size long").repartition(7)
    first, again = (sorted(mix(rows).select("id", "taken").collect()) for _ in range(2))
    assert first == again
    out = mix(rows).toPandas()
    assert len(out) == len(data)
    assert (out["taken"] <= 2 * out["size"]).all()
    for _, g in out.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 0.5
        whole = int(g["target"].iloc[0] + 0.5) // g["source_size"].iloc[0]
        partly = ((g["taken"] != whole * g["size"]) & (g["taken"] != (whole + 1) * g["size"])).sum()
        assert partly <= 1


def test_other_seeds_choose_other_rows(spark):
    rows = spark.createDataFrame([(i, "s", 10) for i in range(200)] + [(999, "t", 1000)], "id long, source string, size long")
    one, two = (dict(mix(rows, seed=s).select("id", "taken").collect()) for s in (1, 2))
    assert one != two


def test_edges_and_texts(spark):
    docs = edge_docs(spark)
    rows = docs.select(F.col("doc_id").alias("id"), "source", word_count(F.col("text")).alias("size"))
    out = mix(rows).toPandas()
    assert len(out) == docs.count()
    assert out["taken"].sum() == pytest.approx(1.5 * out["size"].sum(), abs=3)
    texts = mixed_documents(docs)
    assert texts.columns == docs.columns
    words = texts.select(F.sum(word_count(F.col("text")))).first()[0]
    assert words == out["taken"].sum()
    assert mixed_documents(empty_docs(spark)).count() == 0
    assert mix(rows.limit(0)).count() == 0
