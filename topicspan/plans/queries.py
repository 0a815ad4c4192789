"""The registered queries: one function of (spark, sf_dir) each."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspan.functions import parse_page
from topicspan.operators import (
    classifier,
    clusters,
    compare,
    features,
    ranking,
    splits,
    tokens,
    topic_tables,
    weighting,
)
from topicspan.operators import histogram as histograms
from topicspan.operators import topics as models
from topicspan.plans.curation import curate
from topicspan.plans.discovery import Discovery, discover_tables
from topicspan.plans.supervised import supervise
from topicspan.plans.tables import (
    DIGITS,
    class_count,
    documents,
    language_posterior,
    language_topics,
    new_texts,
    short_texts,
    stand_in_beta,
    stand_in_posterior,
    table,
    with_topic,
)
from topicspan.session import scratch_path, stored
from topicspan.sources import (
    default_labels,
    define_corpus,
    load_label_bundle,
    load_topic_bundle,
    numbered_labels,
    read_corpus_csv,
    read_labels_csv,
    save_label_bundle,
    save_topic_bundle,
    write_clusters,
    write_csv,
)
from topicspan.streaming import stream_labels, stream_topics, text_stream
from topicspan.streaming.scoring import run_batches, run_versioned

Query = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, DIGITS))
    return df


# --- corpus and tokens ------------------------------------------------------


@query
def corpus_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return define_corpus(turns, "text", "role", order_by=["conv_id", "turn"])


@query
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "corpus-csv")
    write_csv(table(spark, sf_dir, "documents"), path)
    return define_corpus(read_corpus_csv(spark, path, ["lang", "text", "doc_id"], multi_line=True), "text", "lang", "doc_id")


@query
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(documents(spark, sf_dir))


@query
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.vocabulary(tokens.without_stop_words(tokens.words(documents(spark, sf_dir))))


@query
def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = documents(spark, sf_dir)
    return tokens.corpus_totals(tokens.token_counts(corpus), corpus)


@query
def frequent_tokens_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokens.document_counts(documents(spark, sf_dir)).drop("total")
    return counts.orderBy(F.desc("n"), "docid", "word").limit(20)


@query
def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.ngram_counts(with_topic(documents(spark, sf_dir)))


@query
def ngrams_per_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.rows_per_topic(tokens.ngram_counts(with_topic(documents(spark, sf_dir)), 2), "nn")


# --- weights ----------------------------------------------------------------


@query
def tf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(weighting.tf_idf(_stored_counts(documents(spark, sf_dir))), "tf", "idf", "tf_idf")


@query
def top_tf_idf_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = documents(spark, sf_dir)
    weights = rounded(weighting.tf_idf(_stored_counts(corpus)), "tf_idf")
    by_class = weights.join(corpus.select("docid", "appTag"), "docid").select(
        "appTag", "docid", "word", "tf_idf"
    )
    return ranking.top_n(stored(by_class, "class-weights"), ["appTag"], "tf_idf", 10)


@query
def corpus_with_new_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = documents(spark, sf_dir)
    return weighting.append_texts(corpus, new_texts(spark, sf_dir, corpus))


def _stored_counts(corpus: DataFrame) -> DataFrame:
    """The token table with document totals; a user has it saved with the model."""
    return stored(tokens.document_counts(corpus), "token-counts")


@query
def new_text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = documents(spark, sf_dir)
    known = tokens.vocabulary(tokens.token_counts(corpus))
    return weighting.new_text_counts(new_texts(spark, sf_dir, corpus), known)


@query
def new_text_tf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = documents(spark, sf_dir)
    frequencies, size = weighting.corpus_statistics(_stored_counts(corpus))
    new = weighting.new_text_counts(new_texts(spark, sf_dir, corpus), frequencies)
    return rounded(weighting.new_text_tf_idf(frequencies, size, new), "tf", "idf", "tf_idf")


@query
def extended_tf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = documents(spark, sf_dir)
    counts = _stored_counts(corpus)
    new = weighting.new_text_counts(new_texts(spark, sf_dir, corpus), tokens.vocabulary(counts))
    return rounded(weighting.extended_tf_idf(counts, new), "tf", "idf", "tf_idf")


# --- topics as tables -------------------------------------------------------


@query
def topic_term_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_topics(spark, sf_dir)[2]


@query
def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.by_strength(ranking.top_terms(language_topics(spark, sf_dir)[2], 10))


@query
def strongest_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.group_max(language_topics(spark, sf_dir)[2], ["topic"], "beta")


@query
def top_terms_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = with_topic(documents(spark, sf_dir, "source"))
    beta = stand_in_beta(corpus, class_count(corpus))
    page = parse_page("11..20")
    return ranking.paged(ranking.in_topic_range(ranking.top_terms(beta, 10), *page))


@query
def top_terms_per_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.rows_per_topic(ranking.top_terms(language_topics(spark, sf_dir)[2], 10))


@query
def term_display_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = ranking.top_terms(language_topics(spark, sf_dir)[2], 10)
    ordered = ranking.display_order(terms)
    return ordered.withColumn("mean_beta", F.round("mean_beta", 9))


@query
def log_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, beta, k = language_topics(spark, sf_dir)
    return rounded(compare.log_ratio(beta, 2, k), "log_ratio")


@query
def log_ratio_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, beta, k = language_topics(spark, sf_dir)
    return rounded(compare.log_ratio(beta, 2, k, topic_range=(1, 3)), "log_ratio")


@query
def log_ratio_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, beta, k = language_topics(spark, sf_dir)
    others = [t for t in range(1, k + 1) if t != 2]
    wide = compare.log_ratio_matrix(compare.log_ratio(beta, 2, k), others)
    return rounded(wide, *[f"topic_{t}" for t in others])


@query
def term_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, _, beta, _ = language_topics(spark, sf_dir)
    return compare.term_ngrams(ranking.top_terms(beta, 10), corpus)


@query
def label_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, _, beta, _ = language_topics(spark, sf_dir)
    return compare.label_candidates(ranking.top_terms(beta, 10), corpus)


@query
def label_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, _, beta, k = language_topics(spark, sf_dir)
    return compare.suggest_labels(default_labels(spark, k), ranking.top_terms(beta, 10), corpus)


@query
def label_suggestions_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, _, beta, k = language_topics(spark, sf_dir)
    return compare.suggest_labels(
        default_labels(spark, k), ranking.top_terms(beta, 10), corpus, n=2, word_boundary=True
    )


# --- clusters ---------------------------------------------------------------


def _clustered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    corpus, _, _, k, posterior = language_posterior(spark, sf_dir)
    labels = numbered_labels(spark, k)
    return clusters.cluster_documents(corpus, posterior, labels), labels, posterior


@query
def doc_topic_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_topic(language_posterior(spark, sf_dir)[4])


@query
def doc_topics_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.topics_ranked(language_posterior(spark, sf_dir)[4])


@query
def clustered_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clustered(spark, sf_dir)[0]


@query
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_sizes(_clustered(spark, sf_dir)[0])


@query
def cluster_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.in_topic(_clustered(spark, sf_dir)[0], 2).select("topic", "label", "docid", "probability")


@query
def cluster_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    clustered, labels, _ = _clustered(spark, sf_dir)
    path = write_clusters(clustered, scratch_path(spark, "clusters"), labels.count())
    return clusters.in_topic(spark.read.parquet(path), 2).select(*clusters.CLUSTER_COLUMNS)


@query
def related_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, counts, beta, k, posterior = language_posterior(spark, sf_dir)
    clustered = clusters.cluster_documents(corpus, posterior, numbered_labels(spark, k))
    known = tokens.vocabulary(counts)
    arrived = stored(weighting.new_text_counts(new_texts(spark, sf_dir, corpus), known), "arrived-counts")
    predicted = ranking.top_topic(stand_in_posterior(arrived, beta, k))
    return clusters.related_documents(clustered, predicted).select("topic", "label", "docid", "probability")


@query
def default_label_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return default_labels(spark, class_count(documents(spark, sf_dir)))


@query
def label_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages with at least their even share of documents get their name."""
    corpus = with_topic(documents(spark, sf_dir))
    k = class_count(corpus)
    total = corpus.agg(F.count(F.lit(1))).scalar()
    named = (
        corpus.groupBy("topic", F.col("appTag").alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") * k >= total)
    )
    return clusters.override_labels(numbered_labels(spark, k), named)


@query
def label_table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = class_count(documents(spark, sf_dir, "source"))
    path = scratch_path(spark, "labels-csv")
    write_csv(numbered_labels(spark, k), path)
    return read_labels_csv(spark, path, k)


# --- labels and features ----------------------------------------------------


def _quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("docid"),
        F.concat_ws("-", F.lit("quality"), "quality", F.lit("toxic"), "toxic").alias("label"),
    )


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the class that was given to them: docid, text, label."""
    return documents(spark, sf_dir).join(_quality_labels(spark, sf_dir), "docid").select(
        "docid", "text", "label"
    )


@query
def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = weighting.tf_idf(_stored_counts(documents(spark, sf_dir)))
    return rounded(features.labelled_features(weights, _quality_labels(spark, sf_dir)), "tf_idf")


@query
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = documents(spark, sf_dir).select("docid", F.col("appTag").alias("label"))
    return splits.stratified_split(corpus)


@query
def class_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = documents(spark, sf_dir).select("docid", F.col("appTag").alias("label"))
    shares = splits.class_shares(splits.stratified_split(corpus, fractions=splits.SCREEN_FRACTIONS))
    return rounded(shares, "pc")


@query
def one_hot_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.one_hot_labels(documents(spark, sf_dir).withColumnRenamed("appTag", "label"))


@query
def treatment_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.one_hot_labels(
        documents(spark, sf_dir).withColumnRenamed("appTag", "label"), drop_first=True
    )


@query
def binary_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = documents(spark, sf_dir)
    known = tokens.vocabulary(tokens.token_counts(corpus))
    arrived = tokens.words(new_texts(spark, sf_dir, corpus))
    return features.binary_features(tokens.known_words_only(arrived, known))


def _stand_in_predictions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Languages predicted for every document, and the corpus."""
    corpus, _, _, _, posterior = language_posterior(spark, sf_dir)
    names = corpus.select("topic", F.col("appTag").alias("predictTag")).distinct()
    best = ranking.top_topic(posterior).join(names, "topic")
    predictions = best.join(corpus.select("docid", F.col("appTag").alias("label")), "docid")
    return predictions.select("docid", "label", "predictTag", "probability"), corpus


@query
def test_predictions_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictions, corpus = _stand_in_predictions(spark, sf_dir)
    test = splits.split_part(splits.stratified_split(predictions), "test")
    return classifier.join_predictions(test, corpus.select("docid", "text", "appTag"))


@query
def evaluate_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, _, _, _, posterior = language_posterior(spark, sf_dir)
    names = corpus.select("topic", F.col("appTag").alias("predictTag")).distinct()
    own = corpus.select("docid", "topic", F.col("appTag").alias("label")).join(posterior, ["docid", "topic"])
    best = ranking.top_topic(posterior).select("docid", "topic").join(names, "topic")
    scored = own.select("docid", "label", "probability").join(best.select("docid", "predictTag"), "docid")
    return rounded(classifier.accuracy_and_loss(scored), "loss", "accuracy")


@query
def history_by_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history-shaped table: turns as epochs, roles as the two data sets."""
    turns = table(spark, sf_dir, "conversations")
    data = F.when(F.col("role") == "user", "training").when(F.col("role") == "assistant", "validation")
    size = F.length("text")
    per_turn = turns.groupBy(F.col("turn").alias("epoch"), data.alias("data")).agg(
        F.avg(size / 1000).alias("loss"), F.avg((size > 200).cast("double")).alias("accuracy")
    )
    history = per_turn.unpivot(["epoch", "data"], ["loss", "accuracy"], "metric", "value")
    wide = classifier.history_by_epoch(history)
    return rounded(wide, "trainLoss", "trainAccuracy", "valLoss", "valAccuracy")


@query
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        histograms.histogram(table(spark, sf_dir, "part"), "p_retailprice", 10), "lower", "upper"
    )


# --- fitted models: rows only -----------------------------------------------

_TOPICS = 5
_LDA = {"iterations": 10}
_NETWORK = {"epochs": 20, "epochs_per_step": 20}
_HISTORY = {"epochs": 20, "epochs_per_step": 1}


def _found(spark: SparkSession, sf_dir: str) -> Discovery:
    return discover_tables(documents(spark, sf_dir), _TOPICS, **_LDA)


def _topic_model(spark: SparkSession, sf_dir: str) -> topic_tables.TopicTable:
    rows = topic_tables.numbered_rows(documents(spark, sf_dir).select("docid", "text"))
    return topic_tables.fit_topic_table(topic_tables.row_blocks(rows), _TOPICS, **_LDA)


def _label_model(spark: SparkSession, sf_dir: str) -> tuple[classifier.LabelModel, DataFrame]:
    labelled = _labelled(spark, sf_dir)
    return classifier.train_label_tables(labelled, **_NETWORK), labelled


@query
def lda_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).beta


@query
def lda_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that each topic of a fitted model knows: all words of the corpus."""
    beta = _found(spark, sf_dir).beta
    return beta.groupBy("topic").agg(
        F.count_distinct("term").alias("terms"), F.round(F.sum("beta"), 6).alias("mass")
    )


@query
def lda_posterior_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics and total probability of each document with a word."""
    model = _topic_model(spark, sf_dir)
    scored = models.posterior(models.score_topics(model, documents(spark, sf_dir)))
    return scored.groupBy("docid").agg(
        F.count(F.lit(1)).alias("topics"), F.round(F.sum("probability"), 6).alias("mass")
    )


@query
def history_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One history row per epoch and set, with both metrics."""
    history = classifier.train_label_tables(_labelled(spark, sf_dir), **_HISTORY).history
    return history.groupBy("epoch", "data").agg(F.count(F.lit(1)).alias("metrics"))


@query
def lda_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _topic_model(spark, sf_dir)
    return models.posterior(models.score_topics(model, documents(spark, sf_dir)))


@query
def lda_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).top


@query
def lda_clustered_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _topic_model(spark, sf_dir)
    scored = models.score_topics(model, documents(spark, sf_dir))
    return clusters.cluster_scored(scored, numbered_labels(spark, _TOPICS))


@query
def lda_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate(_found(spark, sf_dir)).suggestions


@query
def perplexity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topic_tables.numbered_rows(documents(spark, sf_dir).select("docid", "text"))
    found = _perplexities(topic_tables.row_blocks(rows))
    return spark.createDataFrame(
        [(k, math.exp(value), value) for k, value in found],
        "topicCount int, perplexity double, logPerplexity double",
    )


def _perplexities(blocks: topic_tables.Blocks) -> list[tuple[int, float]]:
    """Log perplexity for 2, 4 and 6 topics, all fitted from one pass per iteration."""
    fitted = topic_tables.fit_topic_tables(blocks, [2, 4, 6], **_LDA)
    return [(k, topic_tables.log_perplexity(m, blocks)) for k, m in fitted.items()]


@query
def classify_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = models.score_topics(_topic_model(spark, sf_dir), short_texts(spark, sf_dir))
    return models.ranked_topics(scored, numbered_labels(spark, _TOPICS))


@query
def train_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = classifier.train_label_tables(_labelled(spark, sf_dir), **_HISTORY)
    return classifier.history_by_epoch(model.history)


@query
def classifier_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.evaluate_labels(*_label_model(spark, sf_dir))


@query
def classifier_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.split_predictions(*_label_model(spark, sf_dir))


@query
def classify_labels_tf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _ = _label_model(spark, sf_dir)
    return classifier.classify_with_tf_idf(model, short_texts(spark, sf_dir))


@query
def classify_labels_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _ = _label_model(spark, sf_dir)
    return classifier.classify_with_presence(model, short_texts(spark, sf_dir))


@query
def topic_model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(spark, sf_dir)
    path = scratch_path(spark, "topic-bundle")
    save_topic_bundle(
        path, found.model, found.corpus, found.tokens, found.vectors, {"numTopics": _TOPICS}
    )
    bundle = load_topic_bundle(spark, path)
    labels = numbered_labels(spark, bundle.metadata["numTopics"])
    return clusters.cluster_scored(models.score_topics(bundle.model, bundle.corpus), labels)


def _saved_and_loaded(spark: SparkSession, model: classifier.LabelTable) -> classifier.LabelTable:
    path = scratch_path(spark, "label-bundle")
    save_label_bundle(path, model)
    return load_label_bundle(spark, path)


@query
def classifier_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = _saved_and_loaded(spark, _label_model(spark, sf_dir)[0])
    return classifier.class_scores(loaded.scorer().transform(short_texts(spark, sf_dir)), loaded.classes)


def _same_scores(one: DataFrame, two: DataFrame, name: str) -> DataFrame:
    """(docid, name): do both give a text the same ranking and probabilities?"""
    other = two.select("docid", "rank", F.col("tags").alias("__t"), F.col("probability").alias("__p"))
    same = F.col("tags").eqNullSafe(F.col("__t")) & (F.abs(F.col("probability") - F.col("__p")) < 1e-9)
    return (
        one.join(other, ["docid", "rank"], "full")
        .groupBy("docid")
        .agg(F.every(F.coalesce(same, F.lit(False))).alias(name))
    )


@query
def classifier_reloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does a loaded classifier score each new text as the fitted one does?"""
    model, _ = _label_model(spark, sf_dir)
    loaded, texts = _saved_and_loaded(spark, model), short_texts(spark, sf_dir)
    weighed = [classifier.classify_with_tf_idf(m, texts) for m in (model, loaded)]
    present = [classifier.classify_with_presence(m, texts) for m in (model, loaded)]
    return _same_scores(*weighed, "tf_idf").join(_same_scores(*present, "presence"), "docid")


@query
def curated_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way: topics, their labels, a classifier of these labels, its test documents."""
    found = _found(spark, sf_dir)
    curated = curate(found, numbered_labels(spark, _TOPICS))
    return supervise(curated.clustered, train=classifier.train_label_tables, **_NETWORK).predictions


def _arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A table is one file or a folder of files; the pattern takes either.
    stream = text_stream(
        spark, f"{sf_dir}/conversations.parque[t]", "conv_id long, turn long, role string, text string"
    )
    return stream.select(F.concat_ws("-", "conv_id", "turn").alias("docid"), "text")


@query
def stream_topic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, labels = _topic_model(spark, sf_dir), numbered_labels(spark, _TOPICS)
    path = scratch_path(spark, "topic-stream")
    run_batches(
        _arriving(spark, sf_dir), lambda batch: stream_topics(model, batch, labels), f"{path}/rows", f"{path}/progress"
    )
    return spark.read.parquet(f"{path}/rows").drop("batch")


@query
def stream_label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _ = _label_model(spark, sf_dir)
    path = scratch_path(spark, "label-stream")
    scorer = model.binary_scorer()
    run_batches(
        _arriving(spark, sf_dir), lambda batch: stream_labels(scorer, batch), f"{path}/rows", f"{path}/progress"
    )
    return spark.read.parquet(f"{path}/rows").drop("batch")


# --- the topic model as tables: no vocabulary on the driver -----------------


def _topic_table(spark: SparkSession, sf_dir: str) -> tuple[topic_tables.TopicTable, topic_tables.Blocks]:
    blocks = topic_tables.blocked(tokens.token_counts(documents(spark, sf_dir)))
    return topic_tables.fit_topic_table(blocks, _TOPICS, **_LDA), blocks


@query
def topic_table_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each topic of the table model weighs every word of the corpus, and sums to 1."""
    beta = topic_tables.beta_table(_topic_table(spark, sf_dir)[0])
    return beta.groupBy("topic").agg(
        F.count_distinct("term").alias("terms"), F.round(F.sum("beta"), 6).alias("mass")
    )


@query
def topic_table_posterior_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics and total probability of each document with a word, inferred by join."""
    model, blocks = _topic_table(spark, sf_dir)
    return topic_tables.posterior_table(model, blocks).groupBy("docid").agg(
        F.count(F.lit(1)).alias("topics"), F.round(F.sum("probability"), 6).alias("mass")
    )


@query
def topic_table_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log perplexity of the table model on its corpus: the bound as aggregates."""
    model, blocks = _topic_table(spark, sf_dir)
    value = topic_tables.log_perplexity(model, blocks)
    return spark.createDataFrame([(_TOPICS, value)], "topicCount int, logPerplexity double")


@query
def topic_table_perplexity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log perplexity for 2, 4 and 6 topics, all fitted from one pass per iteration."""
    blocks = topic_tables.blocked(tokens.token_counts(documents(spark, sf_dir)))
    return spark.createDataFrame(_perplexities(blocks), "topicCount int, logPerplexity double")


@query
def stream_versioned_topic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arriving turns scored under the topic bundle version current at each batch."""
    corpus = documents(spark, sf_dir)
    model = _topic_model(spark, sf_dir)
    path = scratch_path(spark, "versioned-stream")
    empty = corpus.limit(0)
    save_topic_bundle(f"{path}/bundle", model, empty, empty, empty, {"numTopics": _TOPICS})
    labels = numbered_labels(spark, _TOPICS)

    def score(found, batch):
        return stream_topics(found.model, batch, labels)

    run_versioned(_arriving(spark, sf_dir), f"{path}/bundle", load_topic_bundle, score, f"{path}/rows", f"{path}/progress")
    return spark.read.parquet(f"{path}/rows").drop("batch")
