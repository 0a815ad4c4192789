"""The topic model as tables against a NumPy brute force of the same algorithm."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from topicspan.operators import topic_tables as tt


def brute_fit(docs, vocab, lam0, k, iterations, alpha, eta):
    lam = lam0.copy()
    a = np.full(k, alpha)
    for t in range(1, iterations + 1):
        elog = tt.digamma(lam) - tt.digamma(lam.sum(axis=0))[None, :]
        stats = np.zeros_like(lam)
        for d in docs:
            ids = [vocab.index(w) for w in sorted(d)]
            cts = np.array([d[w] for w in sorted(d)], dtype="float64")
            _, share = tt.document_step(np.exp(elog[ids]), cts, a)
            stats[ids] += share
        rho = math.pow(tt.TAU0 + t, -tt.KAPPA)
        lam = (1 - rho) * lam + rho * (eta + stats * np.exp(elog))
    return lam


def corpus(seed=2, n=40):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    docs = []
    for d in range(n):
        doc = {}
        for _ in range(rng.randrange(1, 25)):
            w = rng.choice(words[: 10 + (d % 3) * 10])
            doc[w] = doc.get(w, 0) + 1
        docs.append(doc)
    return docs


def token_frame(spark, docs):
    rows = [(f"d{i}", w, n) for i, d in enumerate(docs) for w, n in d.items()]
    rows.append(("empty", "w0", 0))  # a count of 0 is no word
    return spark.createDataFrame(rows, "docid string, word string, n long")


def test_digamma_against_differences():
    x = np.array([0.01, 0.3, 1.0, 2.5, 7.0, 40.0, 1e4])
    h = 1e-6
    by_lgamma = np.array([(math.lgamma(v + h) - math.lgamma(v - h)) / (2 * h) for v in x])
    assert np.allclose(tt.digamma(x), by_lgamma, rtol=1e-6, atol=1e-6)
    assert abs(tt.digamma(np.array([1.0]))[0] + 0.5772156649015329) < 1e-12


def test_fit_equals_brute_force(spark):
    docs, k = corpus(), 3
    tokens = token_frame(spark, docs)
    model = tt.fit_topic_table(tokens, topics=k, iterations=3, seed=7)
    got = {r.word: np.array(r.lam) for r in model.lam.collect()}
    vocab = sorted(got)
    lam0 = {r.word: np.array(r.lam) for r in tt.initial_weights(tokens, k, 7).collect()}
    want = brute_fit(docs, vocab, np.array([lam0[w] for w in vocab]), k, 3, 1 / k, 1 / k)
    assert np.max(np.abs(np.array([got[w] for w in vocab]) - want)) < 1e-9
    beta = tt.beta_table(model).groupBy("topic").sum("beta").collect()
    assert sorted(r.topic for r in beta) == [1, 2, 3] and all(abs(r[1] - 1) < 1e-9 for r in beta)


def test_posterior_and_perplexity_equal_brute_force(spark):
    docs, k = corpus(5, 25), 4
    tokens = token_frame(spark, docs)
    model = tt.fit_topic_table(tokens, topics=k, iterations=2)
    lam = {r.word: np.array(r.lam) for r in model.lam.collect()}
    vocab = sorted(lam)
    w = np.array([lam[v] for v in vocab])
    elog = tt.digamma(w) - tt.digamma(w.sum(axis=0))[None, :]
    a = np.full(k, 1 / k)
    post = {(r.docid, r.topic): r.probability for r in tt.posterior_table(model, tokens).collect()}
    bound, n = 0.0, 0
    for i, d in enumerate(docs):
        ids = [vocab.index(x) for x in sorted(d)]
        cts = np.array([d[x] for x in sorted(d)], dtype="float64")
        gamma, _ = tt.document_step(np.exp(elog[ids]), cts, a)
        for t in range(k):
            assert abs(post[(f"d{i}", t + 1)] - gamma[t] / gamma.sum()) < 1e-12
        bound += tt.document_bound(elog[ids], cts, gamma, a)
        n += int(cts.sum())
    assert not any(doc == "empty" for doc, _ in post)
    eta = 1 / k
    bound += float(np.sum((eta - w) * elog) + np.sum(tt._lgamma(w) - math.lgamma(eta)))
    bound += float(np.sum(math.lgamma(eta * len(vocab)) - tt._lgamma(w.sum(axis=0))))
    assert tt.log_perplexity(model, tokens) == pytest.approx(-bound / n, rel=1e-12)


def test_empty_tokens(spark):
    tokens = spark.createDataFrame([], "docid string, word string, n long")
    model = tt.fit_topic_table(tokens, topics=2, iterations=1)
    assert model.lam.count() == 0 and tt.posterior_table(model, tokens).count() == 0


def test_several_topic_counts_in_one_pass_equal_single_fits(spark):
    docs = corpus(9, 30)
    tokens = token_frame(spark, docs)
    many = tt.fit_topic_tables(tokens, [2, 3], iterations=2, seed=4)
    for k in (2, 3):
        one = tt.fit_topic_table(tokens, topics=k, iterations=2, seed=4)
        a = {r.word: np.array(r.lam) for r in many[k].lam.collect()}
        b = {r.word: np.array(r.lam) for r in one.lam.collect()}
        assert a.keys() == b.keys()
        assert max(np.max(np.abs(a[w] - b[w])) for w in a) < 1e-12
