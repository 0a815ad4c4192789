"""Cases of the fourth review: each failed before its finding was settled."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from topicspan.operators import classifier, features, label_tables, tokens, topic_tables, weighting
from topicspan.plans import queries
from topicspan.session import scratch_path
from topicspan.sources import load_label_bundle, save_label_bundle


def test_a_network_is_fitted_on_all_training_rows(spark, monkeypatch):
    """1,000 rows were fitted. As Spark's network on all rows, from words in several blocks.

    Spark averages over stacks of 128 rows, so the means agree where these are full.
    """
    monkeypatch.setattr(topic_tables, "BLOCK_ENTRIES", 1_500)
    rng = np.random.default_rng(4)
    rows = []
    for i in range(1_600):
        at = sorted(rng.choice(40, 3, replace=False).tolist()) if i % 50 else []
        split = "train" if i < 1_280 else "validation"
        rows.append((str(i), float(i % 3), Vectors.sparse(40, at, rng.random(len(at)).tolist()), split))
    vectors = spark.createDataFrame(rows, ["docid", "label_index", "features", "split"]).persist()
    layers = classifier.layer_sizes(40, 3)
    for epochs, step in ((3, 3), (2, 1)):
        model, history = classifier.train_network(vectors, layers, epochs, step)
        whole = classifier._network(layers, 0, 1234).fit(vectors.limit(1))
        theirs = {}
        for done in range(step, epochs + 1, step):
            start = classifier._network(layers, step, 1234).setInitialWeights(whole.weights)
            whole = start.fit(vectors.where("split = 'train'").coalesce(1))
            for r in whole.transform(vectors).groupBy("split").agg(*classifier.loss_and_accuracy()).collect():
                name = {"train": "training"}.get(r["split"], r["split"])
                theirs |= {(done, name, m): pytest.approx(r[m], abs=1e-6) for m in ("loss", "accuracy")}
        assert np.allclose(model.weights.toArray(), whole.weights.toArray(), atol=1e-6)
        assert {h[:3]: h[3] for h in history} == theirs


def _docs(spark):
    texts = [(str(i), f"{'red' if i % 2 else 'blue'} word{i % 7} word{i % 7} x{i}", "ab"[i % 2]) for i in range(60)]
    texts += [("5", "red red copy", "b"), ("900", "of the", "a"), ("901", None, "a"), (None, "red", "a"), ("902", "red", None)]
    return spark.createDataFrame(texts, "docid string, text string, label string")


def test_a_table_classifier_scores_as_its_words_say(spark, monkeypatch):
    """Words, frequencies and weights are a table, in several blocks."""
    docs = _docs(spark)
    kept = docs.na.drop("any")
    rows = kept.withColumn("docid", F.concat_ws("-", "docid", "text"))
    found = []
    for entries in (30, 1_000_000):
        monkeypatch.setattr(topic_tables, "BLOCK_ENTRIES", entries)
        found.append(classifier.train_label_tables(docs, epochs=4, epochs_per_step=2))
    one, model = found
    counts = tokens.token_counts(rows)
    assert model.documents == one.documents == 61 and model.classes == ["a", "b"]
    words = {r["word"]: (r["df"], np.array(r["w"])) for r in model.words.collect()}
    assert {w: df for w, (df, _) in words.items()} == {
        r["word"]: r["df"] for r in features.word_totals(counts).collect()
    }
    for r in one.words.collect():
        assert np.allclose(words[r["word"]][1], r["w"], atol=1e-9)
    assert np.allclose(one.rest, model.rest, atol=1e-9)
    assert sorted(map(tuple, one.history.collect())) == [
        (e, d, m, pytest.approx(v, abs=1e-9)) for e, d, m, v in sorted(map(tuple, model.history.collect()))
    ]
    sums = {}
    for r in weighting.tf_idf(counts).collect():
        sums[r["docid"]] = sums.get(r["docid"], 0.0) + r["tf_idf"] * words[r["word"]][1]
    scored = model.scorer().transform(rows).select("docid", vector_to_array("probability").alias("p"), "predictTag")
    assert scored.count() == 62
    for r in scored.collect():
        z = sums.get(r["docid"], np.zeros(2))[None]
        want = np.exp(label_tables.forward(z, model.rest, model.layers)[1][0])
        assert np.allclose(r["p"], want, atol=1e-12) and r["predictTag"] == "ab"[int(want.argmax())]


def test_new_texts_meet_a_table_classifier(spark, rows):
    """Idf over the union, presence, and a bundle that comes back."""
    model = classifier.train_label_tables(_docs(spark), epochs=2, epochs_per_step=2)
    new = spark.createDataFrame(
        [("n1", "red red unseen"), ("n1", "blue word1 x3"), (None, "unseen"), ("n2", None)], "docid string, text string"
    )
    words = {r["word"]: (r["df"], np.array(r["w"])) for r in model.words.collect()}
    df = {w: words[w][0] + 1 for w in ("red", "blue", "word1", "x3")}
    idf = {w: np.log((model.documents + 2) / n) for w, n in df.items()}
    texts = [["red"], ["blue", "word1", "x3"], [], []]

    def top(share):
        z = np.array([sum((share(t, w) * words[w][1] for w in t), np.zeros(2)) for t in texts])
        return sorted(np.exp(label_tables.forward(z, model.rest, model.layers)[1].max(axis=1)))

    path = scratch_path(spark, "test-label-table")
    save_label_bundle(path, model)
    loaded = load_label_bundle(spark, path)
    assert loaded.classes == model.classes and (loaded.rest == model.rest).all()
    for m in (model, loaded):
        weighed, present = classifier.classify_with_tf_idf(m, new), classifier.classify_with_presence(m, new)
        assert weighed.columns == ["docid", "rank", "tags", "probability"] and weighed.count() == 4 * 2
        for got, want in ((weighed, top(lambda t, w: idf[w] / len(t))), (present, top(lambda t, w: 1.0))):
            assert np.allclose(sorted(r["probability"] for r in got.where("rank = 1").collect()), want, atol=1e-12)
    assert rows(loaded.history) == rows(model.history)


def test_label_queries_keep_no_vocabulary_on_the_driver(spark, sf_dir, monkeypatch):
    """Each of them collected the words of the corpus."""
    monkeypatch.setattr(classifier, "fit_counter", None)
    found = queries.REGISTRY["classifier_reloaded"](spark, sf_dir).collect()
    assert found and all(r["tf_idf"] and r["presence"] for r in found)
    assert queries.REGISTRY["stream_label_scores"](spark, sf_dir).columns == ["docid", "text", "predictTag", "score"]


def test_one_class_or_no_word_is_no_classifier(spark):
    one = spark.createDataFrame([("1", "red", "a"), ("2", "car", "a")], "docid string, text string, label string")
    with pytest.raises(ValueError, match="two classes"):
        classifier.train_label_tables(one)
    with pytest.raises(ValueError, match="no training row"):
        classifier.train_label_tables(one.withColumn("label", F.col("docid")).withColumn("text", F.lit("of the")))
