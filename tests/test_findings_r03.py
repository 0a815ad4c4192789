"""Cases of the third review: each failed before its finding was settled."""

from __future__ import annotations

import numpy as np
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from topicspan.llm import components
from topicspan.operators import classifier, compare, features, tokens, topic_tables, weighting
from topicspan.operators import topics as models
from topicspan.operators.ranking import group_max
from topicspan.plans import queries, supervise, tables
from topicspan.plans.discovery import discover_tables
from topicspan.plans.tables import documents
from topicspan.session import scratch_path, stored
from topicspan.sources import load_topic_bundle, numbered_labels, save_topic_bundle
from topicspan.streaming import run_available


def test_a_clustered_corpus_has_columns_that_models_also_write(spark):
    """``probability`` of the topic and of the class do not meet."""
    words = ["apple", "pear", "plum", "car", "bus", "tram"]
    rows = [
        (1 + i % 2, f"topic{1 + i % 2}", str(i), " ".join(words[3 * (i % 2) :][: 1 + i % 3]), 0.5)
        for i in range(40)
    ]
    clustered = spark.createDataFrame(
        rows, "topic int, label string, docid string, text string, probability double"
    )
    result = supervise(clustered, epochs=4, epochs_per_step=4)
    predictions = result.predictions
    assert predictions.columns == ["docid", "label", "predictTag", "text"]
    assert predictions.count() == result.model.splits.where(F.col("split") == "test").count() > 0
    assert result.evaluation.first()["accuracy"] is not None


def test_topic_queries_keep_no_vocabulary_on_the_driver(spark, sf_dir, monkeypatch):
    """The model is a table, and every word is in it."""
    monkeypatch.setattr(features, "fit_counter", None)
    monkeypatch.setattr(models, "fit_counter", None)
    found = queries.REGISTRY["lda_vocabulary"](spark, sf_dir).collect()
    corpus = documents(spark, sf_dir)
    words = tokens.vocabulary(tokens.token_counts(corpus)).count()
    assert [(r["terms"], r["mass"]) for r in found] == [(words, 1.0)] * 5


def test_rows_with_equal_or_no_id_are_scored_one_by_one(spark):
    docs = spark.createDataFrame(
        [("1", "red apple"), ("1", "fast car"), (None, "red car"), ("2", "of the"), ("3", None)],
        "docid string, text string",
    )
    found = discover_tables(docs, 2, iterations=2)
    scored = models.score_topics(found.model, docs)
    assert scored.count() == 5
    got = models.posterior(scored).groupBy("docid").agg(F.count("*").alias("n"), F.sum("probability").alias("p"))
    assert {(r["docid"], r["n"], round(r["p"], 9)) for r in got.collect()} == {("1", 4, 2.0), (None, 2, 1.0)}
    new = spark.createDataFrame([("9", "unseen"), ("8", "unseen apple")], "docid string, text string")
    out = {r["docid"]: r["topic"] for r in models.classify_by_topic(
        found.model, new, numbered_labels(spark, 2)).collect()}
    assert out["9"] is None and out["8"] in (1, 2)


def test_many_documents_at_once_equal_one_by_one():
    """the step over a block is the step over each of its documents."""
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 60, 50)
    eb, cts = rng.random((4, sizes.sum())) / 50, rng.integers(1, 5, sizes.sum()).astype(float)
    gamma, elt, ratio = topic_tables.documents_step(eb, cts, sizes, 0.25)
    at = 0
    for d, n in enumerate(sizes):
        own, share = topic_tables.document_step(eb[:, at : at + n].T, cts[at : at + n], np.full(4, 0.25))
        assert np.allclose(gamma[:, d], own, rtol=1e-12)
        assert np.allclose(np.outer(ratio[at : at + n], elt[:, d]), share, rtol=1e-12)
        at += n


def test_streams_read_tables_that_are_folders(spark, sf_dir, tmp_path):
    """the larger tables are folders of files."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    for folder in (sf_dir, str(tmp_path)):
        path = scratch_path(spark, "test-arriving")
        run_available(queries._arriving(spark, folder), f"{path}/rows", f"{path}/progress")
        assert spark.read.parquet(f"{path}/rows").count() == turns.count()


def test_a_table_bundle_comes_back(spark, rows):
    docs = spark.createDataFrame([("1", "red apple"), ("2", "fast car")], "docid string, text string")
    found = discover_tables(docs, 2, iterations=1)
    path = scratch_path(spark, "test-table-bundle")
    save_topic_bundle(path, found.model, docs, found.tokens, found.vectors, {"numTopics": 2})
    loaded = load_topic_bundle(spark, path)
    assert loaded.metadata == {"numTopics": 2} and loaded.vectors.count() == 2
    assert rows(models.score_topics(loaded.model, docs)) == rows(models.score_topics(found.model, docs))


def test_the_fit_has_the_width_of_its_rows(spark):
    """Same network and scores as Spark's over the whole vocabulary."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(60):
        at = sorted(rng.choice(40, 5, replace=False).tolist())
        rows.append((str(i), float(i % 3), Vectors.sparse(40, at, rng.random(5).tolist()), "train" if i < 40 else "validation"))
    vectors = spark.createDataFrame(rows, ["docid", "label_index", "features", "split"]).persist()
    layers = classifier.layer_sizes(40, 3)
    model, history = classifier.train_network(vectors, layers, 4, 4, fit_rows=4)
    drawn = vectors.where("split = 'train'").orderBy(F.md5("docid"), "docid").limit(4)
    whole = classifier._network(layers, 4, 1234).fit(drawn.coalesce(1))
    assert len({w for r in drawn.collect() for w in r["features"].indices}) < 40
    assert np.allclose(model.weights.toArray(), whole.weights.toArray(), atol=1e-6)
    ours = classifier.network_scores(model, vectors).orderBy("docid").collect()
    theirs = model.transform(vectors).orderBy("docid").collect()
    for a, b in zip(ours, theirs, strict=True):
        assert a["prediction"] == b["prediction"]
        assert np.allclose(a["probability"].toArray(), b["probability"].toArray(), atol=1e-12)
    assert len(history) == 4


def test_no_dense_block_of_the_whole_vocabulary(spark, monkeypatch):
    """only a single row, without a step, meets the full width."""
    docs = spark.createDataFrame(
        [(str(i), f"word{i} word{i + 1} {'red' if i % 2 else 'blue'}", "ab"[i % 2]) for i in range(40)],
        "docid string, text string, label string",
    )
    widths = []
    real = classifier._network
    monkeypatch.setattr(classifier, "_network", lambda l, n, s: widths.append((l[0], n)) or real(l, n, s))
    model = classifier.train_labels(docs, epochs=2, epochs_per_step=2, fit_rows=3)
    full = len(model.counter.vocabulary)
    assert all(n == 0 for w, n in widths if w == full) and any(w < full and n == 2 for w, n in widths)


def _exchanged_words(df):
    """Shuffles of the plan that the words of all documents enter."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning(docid" in line and "word" in line]


def test_documents_are_counted_without_a_shuffle_of_words(spark, rows):
    """Equal to ``token_counts``, with copies of ids, null ids and null texts."""
    texts = [(str(i), f"the red{i % 7} car red{i % 7} Car x{i}") for i in range(300)]
    texts += [("5", "red5 bus"), ("5", None), ("6", None), (None, "lost car"), (None, "lost bus"), ("7", "")]
    texts += [("many", f"car y{i}") for i in range(200)] + [(None, f"z{i % 3}") for i in range(200)]
    docs = spark.createDataFrame(texts, "docid string, text string")
    counts = tokens.document_counts(docs)
    assert rows(counts, "docid", "word", "n") == rows(tokens.token_counts(docs))
    totals = tokens.token_counts(docs).groupBy("docid").agg(F.sum("n").alias("total"))
    assert rows(counts.select("docid", "total").distinct()) == rows(totals)
    assert rows(tokens.document_counts(docs, []), "docid", "word", "n") == rows(tokens.token_counts(docs, []))
    plain = spark.createDataFrame(texts[:300], "docid string, text string")
    assert _exchanged_words(tokens.token_counts(plain)) and not _exchanged_words(tokens.document_counts(plain))
    assert tokens.document_counts(docs.limit(0)).count() == 0


def test_weights_of_stored_counts_shuffle_only_rare_words(spark, rows, monkeypatch):
    """equal to the weights of plain counts, whichever words are common."""
    docs = spark.createDataFrame(
        [(str(i), f"red car{i % 5} car{i % 3} x{i}") for i in range(60)] + [(None, "red"), ("3", "bus red")],
        "docid string, text string",
    )
    new = tokens.token_counts(spark.createDataFrame([("900", "red new car1 car1")], "docid string, text string"))
    counts = stored(tokens.document_counts(docs), "test-counts")
    plain = tokens.token_counts(docs)
    for parts in (1, 20, 200_000):
        monkeypatch.setattr(weighting, "COMMON_PARTS", parts)
        assert rows(weighting.tf_idf(counts)) == rows(weighting.tf_idf(plain))
        assert rows(weighting.extended_tf_idf(counts, new)) == rows(weighting.extended_tf_idf(plain, new))


def test_posterior_of_stored_counts(spark, rows, monkeypatch):
    """Common and rare words add up to the same posterior."""
    texts = [(str(i), f"red car{i % 5} x{i % 9}", 1 + i % 2) for i in range(40)]
    corpus = spark.createDataFrame(texts, "docid string, text string, topic int")
    beta = tables.stand_in_beta(corpus, 2)
    more = spark.createDataFrame([("a", "red unknown"), ("b", "unknown"), (None, "car1")], "docid string, text string")
    counts = stored(tokens.document_counts(corpus.select("docid", "text").unionByName(more)), "test-counts")
    found = []
    for parts in (1, 10, 200_000):
        monkeypatch.setattr(tables, "COMMON_PARTS", parts)
        found.append(rows(tables.stand_in_posterior(counts, beta, 2)))
    assert found[0] == found[1] == found[2] and len(found[0]) == 2 * 42
    words = {(r["topic"], r["term"]): r["beta"] for r in beta.collect()}
    p = [words[1, "red"], words[2, "red"]]
    assert [r[2] for r in found[0] if r[0] == "a"] == [round(x / sum(p), 6) for x in p]


def test_components_drop_the_links_they_have_used(spark, monkeypatch):
    """op8: a large group's links are joined once, and not in every round."""
    rng = np.random.default_rng(5)
    n, pairs = 400, set()
    for start in range(0, n, 100):  # groups with 32 links a node, and a long chain
        pairs |= {(start + int(x), start + int(y)) for x, y in rng.integers(0, 90, (2_900, 2))}
    pairs |= {(1_000 + (i * 37) % 211, 1_000 + ((i + 1) * 37) % 211) for i in range(210)} | {(7, 7), (2_000, 2_000)}
    # A star whose centre is the largest node.
    pairs |= {(3_100, 3_000 + i) for i in range(50)}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    sizes = []
    real = components.stored
    monkeypatch.setattr(
        components, "stored", lambda df, name: (out := real(df, name), name == "links" and sizes.append(out.count()))[0]
    )
    links = spark.createDataFrame(sorted(pairs), "a long, b long")
    got = {(r["node"], r["root"]) for r in components.components(links).collect()}
    assert got == {(x, find(x)) for x in parent}
    assert sum(sizes) < 1.5 * sizes[0]
    assert components.components(links.limit(0)).count() == 0


def test_ngrams_are_compiled(spark, rows):
    """runs of words were made by a lambda, which Spark interprets."""
    texts = ["Red apple, red apple red", "it's one", "", None, "a b", "The the THE the"]
    corpus = spark.createDataFrame([(i % 2, t) for i, t in enumerate(texts)], "topic int, text string")
    for n in (1, 2, 3, 5):
        want = []
        for i, t in enumerate(texts):
            found = (t or "").lower().replace(",", "").split()
            want += [(i % 2, " ".join(found[j : j + n])) for j in range(len(found) - n + 1)]
        grams = tokens.ngrams(corpus, n)
        assert rows(grams, "topic", "bigram") == sorted(want, key=repr)
        assert "lambda" not in grams._jdf.queryExecution().executedPlan().toString()


def test_only_ngrams_of_the_strongest_terms_are_counted(spark, rows, monkeypatch):
    """n-grams of every top term were counted, shuffled and kept."""
    corpus = spark.createDataFrame(
        [(1, "red apple pie"), (1, "red apple pie"), (1, "red car"), (1, "blue car park"), (2, "old tram stop"), (None, "red apple pie")],
        "topic int, text string",
    )
    terms = spark.createDataFrame(
        [(1, "absent", 0.9), (1, "red", 0.5), (1, "red", 0.5), (1, "blue", 0.4), (2, "tram", 0.3), (2, "ol", 0.1)],
        "topic int, term string, beta double",
    )
    everything = compare.term_ngrams(terms, corpus)
    want = group_max(group_max(everything, ["topic"], "beta"), ["topic"], "n")
    counted = []
    counting = compare.term_ngrams
    monkeypatch.setattr(compare, "term_ngrams", lambda t, *a: counted.extend(r["term"] for r in t.collect()) or counting(t, *a))
    got = compare.label_candidates(terms, corpus)
    assert rows(got, *want.columns) == rows(want)
    assert rows(got, "topic", "term", "bigram", "n") == [(1, "red", "red apple pie", 4), (2, "ol", "old tram stop", 1)]
    assert sorted(counted) == ["ol", "red", "red"]
