from __future__ import annotations

from collections import Counter
from functools import cache
from pathlib import Path

import numpy as np
import pytest
from helpers import edge_docs, empty_docs, prose

from topicspan.llm import quality_lm
from topicspan.llm.quality_lm import LETTERS, bits_table, classify, good_documents, gram_counts, grams, kneser_ney
from topicspan.session import shared_dir


def model_by_hand(texts):
    """Probability of the last character of an n-gram, as the published formulas give it."""
    tables = {4: Counter(g for t in texts for g in grams(t or "").tolist())}
    for w in (3, 2, 1):
        tables[w] = Counter(g % LETTERS**w for g in tables[w + 1])

    def off(counts):
        n1, n2, n3, n4 = (sum(v == k for v in counts.values()) for k in (1, 2, 3, 4))
        if not (n1 and n2):
            return (0.5, 1.0, 1.5)
        y = n1 / (n1 + 2 * n2)
        found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
        return tuple(min(max(d, 0), i + 1) for i, d in enumerate(found))

    offs = {w: off(t) for w, t in tables.items()}
    all_, freed = {w: Counter() for w in tables}, {w: Counter() for w in tables}
    for w, t in tables.items():
        for g, n in t.items():
            all_[w][g // LETTERS] += n
            freed[w][g // LETTERS] += offs[w][min(n, 3) - 1]

    @cache
    def p(w, g):
        if w == 0:
            return 1 / LETTERS
        c, below = g // LETTERS, p(w - 1, g % LETTERS ** (w - 1))
        if not all_[w][c]:
            return below
        n = tables[w][g]
        return ((n - offs[w][min(n, 3) - 1]) if n else 0) / all_[w][c] + freed[w][c] / all_[w][c] * below

    return p


@pytest.mark.parametrize("texts", [["the cat sat on the mat. The cat!", prose(1, 200), None, ""], ["a"], []])
def test_equals_the_formulas(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    bits = bits_table(kneser_ney(gram_counts(df, "text")))
    p = model_by_hand(texts)
    rng = np.random.default_rng(0)
    some = [*grams("the dog sat, the CAT ran 42 é").tolist(), *rng.integers(0, LETTERS**4, 300).tolist()]
    assert bits[some] == pytest.approx([-np.log2(max(p(4, int(g)), 1e-12)) for g in some], rel=1e-4)
    context = int(grams("the")[-1]) % LETTERS**3
    row = bits[context * LETTERS : (context + 1) * LETTERS]
    assert (2.0 ** -row.astype(float)).sum() == pytest.approx(1, rel=1e-4)


def test_bad_texts_go_and_good_ones_stay(spark):
    good = [(i, prose(i, 120), "en", "s", 1) for i in range(60)]
    junk = {100: " ".join(w + "$$$" for w in prose(1, 90).split()), 101: prose(2, 90).upper().replace(" ", "!! ")}
    rows = good + [(i, t, "en", "s", 1) for i, t in junk.items()]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(100, 0, 0)] + [(1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = good_documents(edge_docs(spark, rows), labels)
    assert {r["doc_id"] for r in out.collect()} == set(range(60))


def test_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(1, 1), (3, 1), (None, None), (2, None)], "doc_id long, quality int")
    out = classify(docs, labels)
    rows = out.select("row.doc_id", "row.text", "perplexity", "kept").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r["perplexity"] is None) == (not r["text"])
        if not r["text"]:
            assert not r["kept"]
    assert good_documents(docs, labels).columns == docs.columns
    assert good_documents(docs, labels.limit(0)).count() == sum(1 for r in rows if r["text"])
    assert classify(empty_docs(spark), labels).count() == 0


def test_classes_fit_the_table():
    found = grams("".join(map(chr, range(0xD7FF))) + "😀")
    assert found.min() >= 0 and found.max() < LETTERS**quality_lm.ORDER


def test_words_count_and_not_only_their_letters(spark):
    """Shuffled words, and Greek in the place of other Greek, had the perplexity of good text."""
    rng = np.random.default_rng(1)
    phrases = [" ".join(f"{'αβγδεζηθικ'[rng.integers(10)]}{'λμνξοπρστυ'[rng.integers(10)]}{i}" for _ in range(6)) for i in "0123456789"]
    good = [(i, " ".join(phrases[j] for j in rng.integers(0, 10, 20)), "el", "s", 1) for i in range(40)]
    shuffled = [(100 + i, " ".join(rng.permutation(t.split())), "el", "s", 1) for i, t, *_ in good[:5]]
    shifted = [(200 + i, "".join(chr(ord(c) + 7) if "α" <= c <= "υ" else c for c in t), "el", "s", 1) for i, t, *_ in good[:5]]
    labels = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int")
    out = classify(edge_docs(spark, good + shuffled + shifted), labels).select("row.doc_id", "perplexity").collect()
    p = {r[0]: r[1] for r in out}
    most = max(p[i] for i in range(40))
    assert min(p[i] for i in p if i >= 100) > 1.3 * most


def test_repeated_words_go_and_toxic_texts_are_not_trusted(spark):
    good = [(i, prose(i, 120), "en", "s", 1) for i in range(60)]
    junk = [(100, "alpha1 " * 800, "en", "s", 1), (101, "\n".join([prose(5, 12)] * 60), "en", "s", 1)]
    odd = [(200 + i, " ".join(f"zq{i}x{j}" for j in range(90)), "en", "s", 1) for i in range(30)]
    labels = spark.createDataFrame(
        [(i, 1, 0) for i in range(40)] + [(200 + i, 1, 1) for i in range(30)], "doc_id long, quality int, toxic int"
    )
    out = good_documents(edge_docs(spark, good + junk + odd), labels)
    assert {r["doc_id"] for r in out.collect()} == set(range(60))


def test_hashes_are_those_of_the_words():
    texts = ["a\tb", "", " x\x0by\x00 ", "é 𠮷 " + "z" * 70 + " w" * 3, "longer-than-eight longer-than-eighty " + "q" * 64, " \n"]
    at, hashes = quality_lm.word_hashes(texts)
    words = [(i, w) for i, t in enumerate(texts) for w in quality_lm._word.findall(t)]
    assert at.tolist() == [i for i, _ in words]
    known = {}
    assert all(known.setdefault(w, h) == h for (_, w), h in zip(words, hashes.tolist(), strict=True))
    assert len(set(known.values())) == len(known)
    doc, before, word = quality_lm.text_pairs(texts, np.zeros(len(texts), dtype=np.int64))
    assert np.bincount(doc).tolist() == [len(quality_lm._word.findall(t)) + 1 for t in texts]
    for i in range(len(texts)):
        assert sorted(before[doc == i]) == sorted(word[doc == i])


def test_pairs_of_texts_are_not_stored(spark):
    rows = [(i, prose(i, 1000), "en", "s", 1) for i in range(400)]
    docs = edge_docs(spark, rows)
    labels = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int")
    folder = Path(shared_dir(spark).removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*.parquet"))
    before = size()
    judged = classify(docs, labels, keep=["doc_id"])
    assert size() - before < sum(len(r[1]) for r in rows)
    assert judged.count() == 400


def test_copies_are_judged_alike(spark):
    rows = [(i, prose(i, 120), "en", "s", 1) for i in range(30)]
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    alone = classify(edge_docs(spark, rows), labels).select("row.doc_id", "perplexity").collect()
    copies = [(100 + i, rows[25][1], "de", "s", 1) for i in range(3)]
    both = classify(edge_docs(spark, rows + copies), labels).select("row.doc_id", "perplexity").collect()
    one, two = dict(map(tuple, alone)), dict(map(tuple, both))
    assert all(two[i] == pytest.approx(one[i], rel=1e-9) for i in one)
    assert all(two[100 + i] == pytest.approx(one[25], rel=1e-9) for i in range(3))
