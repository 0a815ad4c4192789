"""Properties of fitted models; their numbers have no SQL form."""

from __future__ import annotations

import math

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

import __spark_entry__ as contract
from topicspan.operators import classifier, clusters, tokens, weighting
from topicspan.operators import topics as models
from topicspan.plans import curate, discover, supervise
from topicspan.plans.tables import documents, short_texts
from topicspan.session import scratch_path
from topicspan.sources import (
    default_labels,
    load_label_bundle,
    load_topic_bundle,
    numbered_labels,
    save_label_bundle,
    save_topic_bundle,
)
from topicspan.streaming import (
    run_available,
    run_continuously,
    stream_labels,
    stream_topics,
    text_stream,
)

K = 4
LDA = {"iterations": 5}


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    return documents(spark, sf_dir)


@pytest.fixture(scope="module")
def found(corpus):
    return discover(corpus, K, terms=5, **LDA)


@pytest.fixture(scope="module")
def labelled(spark, sf_dir, corpus):
    return corpus.withColumnRenamed("appTag", "label")


@pytest.fixture(scope="module")
def trained(labelled):
    return supervise(labelled, epochs=20, epochs_per_step=10)


def test_flagship_query(spark):
    assert contract.entry(spark).count() >= 50


def test_beta_sums_to_one_per_topic(found):
    sums = found.beta.groupBy("topic").agg(F.sum("beta").alias("s"), F.count("*").alias("n")).collect()
    assert sorted(r["topic"] for r in sums) == list(range(1, K + 1))
    assert all(r["s"] == pytest.approx(1.0) for r in sums)
    assert {r["n"] for r in sums} == {len(models.known_words(found.model))}


def test_vocabulary_is_that_of_the_token_table(found):
    words = {r["word"] for r in tokens.vocabulary(found.tokens).collect()}
    assert set(models.known_words(found.model)) == words


def test_posterior_sums_to_one_for_documents_with_tokens(found, corpus):
    p = models.posterior(models.score_topics(found.model, corpus))
    sums = p.groupBy("docid").agg(F.sum("probability").alias("s"), F.count("*").alias("n")).collect()
    assert len(sums) == found.tokens.select("docid").distinct().count()
    assert all(r["s"] == pytest.approx(1.0) and r["n"] == K for r in sums)


def test_scoring_runs_the_model_once_per_text(found, corpus, spark):
    scored = models.score_topics(found.model, corpus)
    for df in (
        models.posterior(scored),
        clusters.cluster_scored(scored, default_labels(spark, K)),
        models.ranked_topics(scored, default_labels(spark, K)),
    ):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("UDF(UDF(UDF(UDF(") == 1, plan


def test_row_wise_and_table_assignment_agree(found, corpus, spark, rows):
    scored = models.score_topics(found.model, corpus).persist()
    labels = numbered_labels(spark, K)
    by_row = clusters.cluster_scored(scored, labels)
    by_table = clusters.cluster_documents(corpus, models.posterior(scored), labels)
    assert rows(by_row) == rows(by_table)


def test_same_seed_same_model(found, corpus):
    again = discover(corpus, K, terms=5, **LDA)
    assert models.known_words(again.model) == models.known_words(found.model)
    assert again.top.collect() == found.top.collect()


def test_unknown_words_have_no_topic(found, spark, rows):
    texts = spark.createDataFrame(
        [("1", "zzzzq qqqqz"), ("2", ""), ("3", found.top.first()["term"])], "docid string, text string"
    )
    labels = numbered_labels(spark, K)
    out = {r["docid"]: r for r in models.classify_by_topic(found.model, texts, labels).collect()}
    assert out["1"]["topic"] is None and out["2"]["topic"] is None and out["1"]["label"] is None
    assert out["3"]["label"] == f"topic{out['3']['topic']}"
    ranked = models.ranked_topics(models.score_topics(found.model, texts), labels).orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, K + 1))
    assert {r["docid"] for r in ranked} == {"3"}
    p = [r["probability"] for r in ranked]
    assert p == sorted(p, reverse=True) and ranked[0]["topic"] == out["3"]["topic"]


def test_perplexity_sweep(corpus):
    vectors = models.document_vectors(corpus, models.vector_pipeline(corpus))
    curve, fitted = models.perplexity_sweep(vectors, [2, 3], iterations=3)
    rows = curve.orderBy("topicCount").collect()
    assert [r["topicCount"] for r in rows] == [2, 3] == sorted(fitted)
    assert all(r["perplexity"] == pytest.approx(math.exp(r["logPerplexity"])) for r in rows)
    assert models.perplexity(fitted[2], vectors) == pytest.approx(rows[0]["perplexity"])


def test_curation_applies_overrides(found, spark):
    mine = spark.createDataFrame([(2, "mine")], "topic int, label string")
    result = curate(found, overrides=mine, ngram=2)
    labels = {r["topic"]: r["label"] for r in result.labels.collect()}
    assert labels == {1: "unknown", 2: "mine", 3: "unknown", 4: "unknown"}
    assert result.suggestions.where("suggestions is not null").count() > 0
    sizes = result.sizes.agg(F.sum("n")).first()[0]
    assert sizes == result.clustered.count() == found.tokens.select("docid").distinct().count()


def test_topic_bundle_round_trip(found, corpus, spark, rows):
    path = scratch_path(spark, "test-topics")
    save_topic_bundle(
        path, found.model, corpus, found.tokens, models.document_term_rows(found.vectors), {"numTopics": K}
    )
    bundle = load_topic_bundle(spark, path)
    assert bundle.metadata == {"numTopics": K}
    assert bundle.tokens.count() == found.tokens.count()
    assert bundle.vectors.count() == found.tokens.select("docid").distinct().count()
    labels = numbered_labels(spark, K)
    before = clusters.cluster_scored(models.score_topics(found.model, corpus), labels)
    after = clusters.cluster_scored(models.score_topics(bundle.model, bundle.corpus), labels)
    assert rows(before) == rows(after)


def test_splits_of_the_classifier(trained, labelled):
    splits = trained.model.splits
    assert splits.count() == splits.select("docid").distinct().count()
    assert {r["split"] for r in trained.shares.collect()} == {"train", "validation", "test"}
    assert trained.predictions.count() == splits.where("split = 'test'").count()


def test_history_improves(trained):
    history = trained.history.orderBy("epoch").collect()
    assert [r["epoch"] for r in history] == [10, 20]
    assert history[-1]["trainLoss"] <= history[0]["trainLoss"] + 1e-6
    assert 0 <= history[-1]["valAccuracy"] <= 1


def test_evaluation_agrees_with_predictions(trained):
    hits = trained.predictions.agg(F.avg((F.col("label") == F.col("predictTag")).cast("double"))).first()[0]
    assert trained.evaluation.first()["accuracy"] == pytest.approx(hits)


def test_class_scores_are_complete_and_sorted(trained, spark, sf_dir):
    texts = short_texts(spark, sf_dir)
    for scores in (
        classifier.classify_with_tf_idf(trained.model, texts),
        classifier.classify_with_presence(trained.model, texts),
    ):
        per_text = scores.groupBy("docid").agg(
            F.count("*").alias("n"), F.sum("probability").alias("s"), F.collect_list("probability").alias("p")
        ).collect()
        assert len(per_text) == texts.count()
        assert all(r["n"] == 4 and r["s"] == pytest.approx(1.0) for r in per_text)


def test_pipeline_features_are_tf_idf(spark):
    docs = spark.createDataFrame(
        [(str(i), t, c) for i, (t, c) in enumerate(
            [("red apple apple", "f"), ("green pear", "f"), ("fast car red", "v"), ("slow car", "v"),
             ("green apple", "f"), ("red car", "v"), ("the of", "f")], 1)],
        "docid string, text string, label string",
    )
    model = classifier.train_labels(docs, epochs=2, epochs_per_step=1)
    assert model.documents == 6
    words = model.counter.vocabulary
    expected = {
        (r["docid"], r["word"]): r["tf_idf"]
        for r in weighting.tf_idf(tokens.token_counts(docs)).collect()
    }
    for row in model.pipeline().transform(docs).select("docid", vector_to_array("features").alias("f")).collect():
        for word, value in zip(words, row["f"], strict=True):
            assert value == pytest.approx(expected.get((row["docid"], word), 0.0))


def test_new_text_features_use_the_idf_of_the_union(spark):
    docs = spark.createDataFrame(
        [(str(i), t, c) for i, (t, c) in enumerate(
            [("red apple", "f"), ("green pear", "f"), ("fast car", "v"), ("slow car", "v")], 1)],
        "docid string, text string, label string",
    )
    model = classifier.train_labels(docs, epochs=2, epochs_per_step=1)
    new = spark.createDataFrame(
        [("5", "red car unseen"), ("6", "car car"), ("7", "unseen")], "docid string, text string"
    )
    counts = tokens.token_counts(docs)
    fresh = weighting.new_text_counts(new, counts)
    weights = weighting.new_text_tf_idf(*weighting.corpus_statistics(counts), fresh)
    idf = {r["word"]: r["idf"] for r in weights.collect()}
    assert idf == {"red": pytest.approx(math.log(6 / 2)), "car": pytest.approx(math.log(6 / 4))}
    scores = classifier.classify_with_tf_idf(model, new)
    assert scores.count() == 3 * 2


def test_label_bundle_round_trip(trained, spark, sf_dir, rows):
    path = scratch_path(spark, "test-labels")
    model = trained.model
    save_label_bundle(path, model)
    with pytest.raises(Exception, match="exists"):
        save_label_bundle(path, model)
    save_label_bundle(path, model, mode="overwrite")
    loaded = load_label_bundle(spark, path)
    assert (loaded.classes, loaded.documents, loaded.frequencies) == (model.classes, model.documents, model.frequencies)
    texts = short_texts(spark, sf_dir)
    for score in (classifier.classify_with_tf_idf, classifier.classify_with_presence):
        assert rows(score(loaded, texts)) == rows(score(model, texts))
    assert rows(loaded.history) == rows(model.history)
    # Training goes on from the loaded weights.
    more = classifier.layer_sizes(len(loaded.frequencies), len(loaded.classes))
    assert loaded.network.getLayers() == more == model.network.getLayers()
    assert (loaded.network.weights.toArray() == model.network.weights.toArray()).all()


def test_one_class_is_no_classifier(spark):
    one = spark.createDataFrame([(str(i), f"word{i} more", "same") for i in range(9)], "docid string, text string, label string")
    with pytest.raises(ValueError, match="two classes"):
        classifier.train_labels(one)


def arriving(spark, sf_dir):
    stream = text_stream(
        spark, sf_dir, "conv_id long, turn long, role string, text string", files="conversations.parquet"
    )
    return stream.select(F.concat_ws("-", "conv_id", "turn").alias("docid"), "text")


def test_topic_stream_equals_batch(found, spark, sf_dir, rows):
    labels = numbered_labels(spark, K)
    path = scratch_path(spark, "test-stream")
    run_available(stream_topics(found.model, arriving(spark, sf_dir), labels), f"{path}/rows", f"{path}/progress")
    batch = models.classify_by_topic(found.model, short_texts(spark, sf_dir), labels)
    assert rows(spark.read.parquet(f"{path}/rows")) == rows(batch)


def test_label_stream_equals_batch_and_does_not_repeat(trained, spark, sf_dir, rows):
    pipeline = trained.model.binary_pipeline()
    path = scratch_path(spark, "test-stream")
    for _ in range(2):
        run_available(stream_labels(pipeline, arriving(spark, sf_dir)), f"{path}/rows", f"{path}/progress")
    batch = stream_labels(pipeline, short_texts(spark, sf_dir))
    assert rows(spark.read.parquet(f"{path}/rows")) == rows(batch)


def test_continuous_stream_picks_up_new_files(found, spark, tmp_path):
    folder, path = str(tmp_path / "in"), scratch_path(spark, "test-stream")
    schema = "docid string, text string"
    word = found.top.first()["term"]
    spark.createDataFrame([("1", word)], schema).write.parquet(folder)
    scored = stream_topics(found.model, text_stream(spark, folder, schema), numbered_labels(spark, K))
    query = run_continuously(scored, f"{path}/rows", f"{path}/progress", "0 seconds")
    try:
        query.processAllAvailable()
        assert spark.read.parquet(f"{path}/rows").count() == 1
        spark.createDataFrame([("2", word), ("3", "")], schema).write.mode("append").parquet(folder)
        query.processAllAvailable()
    finally:
        query.stop()
    out = {r["docid"]: r["topic"] for r in spark.read.parquet(f"{path}/rows").collect()}
    assert set(out) == {"1", "2", "3"} and out["1"] == out["2"] and out["3"] is None
