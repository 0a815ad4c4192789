from __future__ import annotations

import random
from collections import Counter

import pytest
from helpers import edge_docs, empty_docs, prose

from topicspan.llm.quality_rules import duplicate_lines, fences, measure_text, merged, quality_rules, repeated_words, sketch
from pyspark.sql import functions as F


def repeated_by_hand(words, window=8):
    seen = Counter(tuple(words[i : i + window]) for i in range(len(words) - window + 1))
    cover = set()
    for i in range(len(words) - window + 1):
        if seen[tuple(words[i : i + window])] > 1:
            cover.update(range(i, i + window))
    return len(cover)


@pytest.mark.parametrize("seed", range(30))
def test_repeated_words_by_hand(seed):
    rng = random.Random(seed)
    words = [rng.choice("abc"[: rng.choice([1, 2, 3])]) for _ in range(rng.choice([0, 1, 7, 8, 9, 16, 40, 200]))]
    assert repeated_words(words) == repeated_by_hand(words)


def test_lines_and_counts():
    assert duplicate_lines("a\n\n \na\nb\r\nb\r\n") == 2
    assert measure_text("A #b c $$!!\n")[:4] == [3, 9, 3, 0]
    assert measure_text("") == [0] * 8


def test_sketches_merge_and_keep_six_bits(spark):
    values = spark.createDataFrame([(i % 3, v) for i, v in enumerate([0, 1, 63, 64, 65, 100, 1000, 123456])], "g int, v long")
    whole = sorted(map(tuple, sketch(values.selectExpr("0 AS k", "v"), ["k"], "v").collect()))
    parts = sorted(map(tuple, merged(sketch(values.selectExpr("0 AS k", "g", "v"), ["k", "g"], "v"), ["k"]).collect()))
    assert whole == parts
    for _, bucket, _ in whole:
        assert bin(bucket)[2:].rstrip("0").__len__() <= 6
    got = fences(sketch(spark.range(101).selectExpr("0 AS k", "id"), ["k"], "id"), ["k"], F.lit(0).alias("least")).first()
    assert got["fence"] == 50 + 3 * 25


def test_junk_goes_and_clean_texts_stay(spark):
    rows = [(i, prose(i, 150), "en", f"s{i % 3}", 1) for i in range(60)]
    junk = {100: " ".join(w + "***" for w in prose(1, 90).split()), 101: prose(2, 90).upper().replace(" ", "!! "), 102: "word again here " * 90, 103: "few"}
    rows += [(i, t, "en", "s1", 1) for i, t in junk.items()]
    out = {r["doc_id"]: r for r in quality_rules(edge_docs(spark, rows)).collect()}
    assert {i for i, r in out.items() if not r["kept"]} == set(junk)
    assert {i for i, r in out.items() if r["base_failed"]} == {102, 103}


def test_edges(spark):
    docs = edge_docs(spark)
    out = quality_rules(docs).collect()
    assert len(out) == docs.count()
    none = [r for r in out if r["n_words"] == 0]
    assert len(none) == 4 and all(r["base_failed"] and not r["kept"] for r in none)
    assert all(r["kept"] is not None and r["base_failed"] is not None for r in out)
    assert quality_rules(empty_docs(spark)).count() == 0
