from __future__ import annotations

import random

import pytest
import sentencepiece
from helpers import edge_docs, empty_docs
from public_tokenizers import path
from pyspark.sql import functions as F

from topicspan.llm.token_counts import PieceCounter, count_tokens

MODEL = path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


PIECES = ["a", "b", "the", "he", "▁", " ", "  ", "é", "\n", "𠮷", "12", "=", "==", "aaaa", "in", "ing", " " * 9, "ab", "<s>", "t", "h", "e", "r"]


@pytest.mark.parametrize("seed", range(3))
def test_counts_equal_the_library(library, seed):
    rng, counter = random.Random(seed), PieceCounter(MODEL)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.choice([2, 9, 60, 300]))) for _ in range(400)]
    assert counter.count_all(texts) == [len(x) for x in library.encode(texts)]


@pytest.mark.parametrize("text", ["a" * 9000, " " * 4000, "=" * 3000, "ab" * 3000, "x" + " " * 5000 + "y", "𠮷" * 3000])
def test_long_pre_tokens(library, text):
    assert PieceCounter(MODEL).count(text) == len(library.encode(text))


def test_long_and_short_ways_agree(library):
    rng, counter = random.Random(7), PieceCounter(MODEL)
    for _ in range(300):
        word = "▁" + "".join(rng.choice("aehinrst=é") for _ in range(rng.randrange(1, 60)))
        assert counter.merge([word]) == [counter.merge_long(word)]


def test_edges(spark, library):
    docs = edge_docs(spark)
    out = count_tokens(docs, F.col("text"), MODEL, [F.col("doc_id"), F.col("text").alias("t")]).toPandas()
    assert len(out) == docs.count()
    for r in out.itertuples():
        text = r.t or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(library.encode(text)))
        assert r.over_limit == (r.n_tokens > 4096)
    assert out["over_limit"].any()
    assert count_tokens(empty_docs(spark), F.col("text"), MODEL, [F.col("doc_id")]).count() == 0
