from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from helpers import edge_docs, empty_docs
from public_tokenizers import path
from tokenizers import Tokenizer

from topicspan.llm.packing import Plan, WordEncoder, packed_documents

FILE = path("word_bpe_49k.json")


@pytest.mark.parametrize("seed", range(12))
def test_plans_place_every_piece_without_gaps(seed):
    rng = np.random.default_rng(seed)
    length = int(rng.choice([7, 40, 256]))
    available = {int(k): int(v) for k, v in zip(rng.integers(1, length + 1, 15), rng.integers(1, 300, 15), strict=True)}
    plan = Plan(available, length)
    held, fill = {}, {}
    for size, first, count, sequence, offset in plan.slots:
        for i in range(count):
            assert held.setdefault((size, first + i), sequence + i) == sequence + i
            fill.setdefault(sequence + i, []).append((offset, size))
    assert len(held) == sum(available.values())
    for parts in fill.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    assert sorted(fill) == list(range(plan.sequences))
    total = sum(k * v for k, v in available.items())
    assert -(-total // length) <= plan.sequences <= 1.25 * total / length + 1


def test_exact_combinations_are_found():
    assert Plan({10: 2}, 10).sequences == 2
    assert Plan({7: 5, 3: 5}, 10).sequences == 5
    assert Plan({5: 6, 3: 6, 2: 6}, 10).sequences == 6
    assert Plan({4: 4, 3: 4, 2: 4, 1: 4}, 10).sequences == 4
    assert Plan({}, 10).sequences == 0


def test_words_give_the_ids_of_whole_texts():
    tokenizer, encoder, rng = Tokenizer.from_file(FILE), WordEncoder(FILE), random.Random(3)
    parts = ["a", "The", "don't", " ", " ", "é", "é", "\n", "<|endoftext|>", "<|ENDOFTEXT|>", "ΣΑΣ", "1234", "--", "́", "\t", "'s", "İ", "x.", "y,", ".,", "É,", "ß", "\u00aa", "\u0149", "ñandú"]
    texts = ["".join(rng.choice(parts) for _ in range(20)) for _ in range(1500)]
    for text, got in zip(texts, encoder.encode_all(texts), strict=True):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got, dtype="<u4").tolist() == want, text


def test_edges(spark):
    docs = edge_docs(spark)
    out = packed_documents(docs, FILE).toPandas()
    tokenizer = Tokenizer.from_file(FILE)
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for i in range(0, len(ids), 4096):
            part = ids[i : i + 4096]
            want.append((str(r["doc_id"]), i // 4096, i, len(part), zlib.crc32(part.tobytes())))
    ids = out["doc_id"].astype("Int64").astype(str).str.replace("<NA>", "None")
    got = zip(ids, out["piece"], out["start"], out["length"], out["ids_crc32"], strict=True)
    assert sorted(got) == sorted(want)
    for _, g in out.groupby("sequence_id"):
        at = 0
        for r in g.sort_values("offset").itertuples():
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert out["sequence_id"].nunique() == -(-out["length"].sum() // 4096)
    assert packed_documents(empty_docs(spark), FILE).count() == 0


def test_plain_words_are_encoded_many_at_once():
    """op2, CPU seconds: each different word was a text of its own for the tokenizer."""
    words = [f"{a}{b}{c}" for a in "abcdefghij" for b in "klmnopqrst" for c in ("ing", "tion", "é", "")]
    encoder, handed = WordEncoder(FILE), []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            handed.extend(texts)
            return plain.encode_batch_fast(texts, **options)

    plain, encoder.plain = encoder.plain, Counting()
    got = encoder.encode_all([" ".join(words), " ".join(reversed(words)), ""])
    assert len(handed) == 1 and sorted(handed[0].split()) == sorted(words)
    tokenizer = Tokenizer.from_file(FILE)
    for text, ids in zip([" ".join(words), " ".join(reversed(words)), ""], got, strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
