from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
from helpers import edge_docs, edge_rows, empty_docs

from topicspan.llm import suffix_dedup
from topicspan.llm.suffix_dedup import anchors, without_repeats


def by_hand(texts, length=400):
    starts = Counter()
    data = [(t or "").encode() for t in texts]
    for b in data:
        starts.update(b[s : s + length] for s in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if starts[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def found(spark, docs):
    rows = without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    return sorted(tuple(r)[1:] for r in rows)


def test_equals_comparing_all_strings(spark):
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    passage, other = letters(700), letters(390)
    texts = [letters(900) + passage + letters(50), passage + letters(500), letters(100) + passage[150:560] + letters(60)]
    texts += [letters(40) + other, other + letters(40), passage[:399], passage[:400], passage[300:]]
    texts += [letters(1500)] * 3 + ["a" * 1200, "a" * 399, "ab" * 700, "", None, "x" * 400]
    base = letters(4000)
    for i in range(6):  # near copies
        at = rng.randrange(3500)
        texts.append(base[:at] + letters(5) + base[at + rng.randrange(9) :])
    repeated = letters(450)
    texts.append(repeated + letters(300) + repeated)  # within one text
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    assert found(spark, docs) == sorted(by_hand(texts))


def test_segments_do_not_change_anchors(monkeypatch):
    rng = np.random.default_rng(1)
    for data in (rng.integers(97, 101, 9000), np.full(3000, 97), np.tile(np.arange(97, 107), 500)):
        data = data.astype(np.uint8)
        whole = anchors(data, 7)
        monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
        parts = anchors(data, 7)
        monkeypatch.undo()
        assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
        assert whole[1][0] == 0 and whole[2][-1] == len(data) - 400
        assert (whole[1][1:] == whole[2][:-1] + 1).all()
        assert ((whole[0] >= whole[2]) & (whole[0] <= whole[1] + 368)).all()


def test_edges(spark):
    rows = [r for r in edge_rows() if r[0] != 6]
    docs = edge_docs(spark, rows)
    assert found(spark, docs) == sorted(by_hand([r[1] for r in rows]))
    assert without_repeats(empty_docs(spark)).count() == 0
    assert without_repeats(edge_docs(spark)).count() == len(edge_rows())
