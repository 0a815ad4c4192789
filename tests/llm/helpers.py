"""Rows that every operator must stand: nulls, empty and long texts, ties, repeats, clashing names."""

from __future__ import annotations

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma".split()


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(words))


def edge_rows() -> list[tuple]:
    long = prose(1, 30_000)
    shared = prose(2, 120)
    return [
        (1, shared, "en", "a", 1),
        (2, shared, "en", "b", 2),
        (2, shared, "en", "b", 2),  # a repeated row
        (3, None, "en", "a", None),
        (4, "", None, None, 0),
        (5, " \t\n", "de", "a", 3),
        (6, long, "en", None, 5),
        (None, prose(3, 80), None, "b", 7),
        (None, None, None, None, None),
        (7, shared + " and a few words more", "en", "a", 9),
        (8, "one", "fr", "c", 3),
        (9, "é 𠮷 ▁ \x00 ﬁ <|endoftext|> </s>", "fr", "c", 30),
    ]


CLASHING = ["size", "taken", "kept", "row", "node", "unit", "id", "n_words", "__text", "lang2", "rank", "spans", "target"]


def edge_docs(spark, rows=None):
    docs = spark.createDataFrame(
        edge_rows() if rows is None else rows,
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    for c in CLASHING:  # further columns, named as the operators name theirs
        docs = docs.selectExpr("*", f"'x' AS {c}")
    return docs


def empty_docs(spark):
    return edge_docs(spark, [])
