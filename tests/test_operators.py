"""Micro fixtures for tie rules, edge cases and documented divergences."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from topicspan.functions import page_of, parse_page, strip_prefix, word_array
from topicspan.operators import classifier, clusters, compare, features, ranking, splits, tokens, weighting
from topicspan.operators.histogram import histogram
from topicspan.operators.ids import largest_id, with_row_ids
from topicspan.sources import default_labels


def corpus(spark, *texts):
    return spark.createDataFrame(
        [(str(i), t) for i, t in enumerate(texts, 1)], "docid string, text string"
    )


def test_words_are_lower_case_and_keep_inner_apostrophes(spark):
    df = corpus(spark, "Don't PANIC, it's 42°—\"Größe\"!").select(word_array("text").alias("w"))
    assert df.first()["w"] == ["don't", "panic", "it's", "42", "größe"]


def test_token_counts_drop_stop_words_and_empty_texts(spark, rows):
    df = corpus(spark, "the cat and the cat", "the of and", "")
    assert rows(tokens.token_counts(df)) == [("1", "cat", 2)]


def test_stop_words_as_list_and_as_table_agree(spark, rows):
    df = corpus(spark, "red car red bus", "blue bus")
    table = spark.createDataFrame([("red",), ("blue",)], "word string")
    listed = rows(tokens.token_counts(df, ["red", "blue"]))
    assert listed == rows(tokens.token_counts(df, table)) == [
        ("1", "bus", 1), ("1", "car", 1), ("2", "bus", 1),
    ]


def test_equal_docids_are_counted_together(spark, rows):
    df = spark.createDataFrame([("1", "car"), ("1", "car bus")], "docid string, text string")
    assert rows(tokens.token_counts(df)) == [("1", "bus", 1), ("1", "car", 2)]


def test_words_named_like_columns_do_no_harm(spark, rows):
    df = corpus(spark, "label topic docid word n", "label tf_idf")
    weights = weighting.tf_idf(tokens.token_counts(df, []))
    assert rows(weights.where("docid = '1'"), "word", "n") == [
        ("docid", 1), ("label", 1), ("n", 1), ("topic", 1), ("word", 1),
    ]


def test_tf_idf_is_unsmoothed(spark):
    df = corpus(spark, "apple apple pear", "pear plum")
    found = {(r["docid"], r["word"]): r for r in weighting.tf_idf(tokens.token_counts(df)).collect()}
    assert found["1", "apple"]["tf"] == pytest.approx(2 / 3)
    assert found["1", "apple"]["idf"] == pytest.approx(math.log(2))
    assert found["1", "pear"]["tf_idf"] == 0.0
    assert found["2", "plum"]["tf_idf"] == pytest.approx(math.log(2) / 2)


def test_ngrams_of_short_texts(spark, rows):
    df = corpus(spark, "two words", "now three words", "a b c d").withColumn("topic", F.lit(1))
    assert rows(tokens.ngram_counts(df)) == [
        ("a b c", 1, 1), ("b c d", 1, 1), ("now three words", 1, 1),
    ]
    assert tokens.ngram_counts(df, 2).count() == 6


def test_top_n_keeps_ties_and_min_rank(spark, rows):
    beta = spark.createDataFrame(
        [(1, "a", 0.4), (1, "b", 0.2), (1, "c", 0.2), (1, "d", 0.1), (1, "e", 0.1),
         (2, "a", 0.2), (2, "b", 0.2), (2, "c", 0.2), (2, "d", 0.2), (2, "e", 0.2)],
        "topic int, term string, beta double",
    )
    top = rows(ranking.top_terms(beta, 2), "topic", "term")
    assert top == [(1, "a"), (1, "b"), (1, "c"), *[(2, t) for t in "abcde"]]
    assert rows(ranking.top_terms(beta, 1), "topic", "term")[0] == (1, "a")


def test_top_n_of_a_hot_group_equals_rank(spark, rows):
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50 + 1).alias("topic"),
        F.col("id").alias("term"),
        (F.hash("id") % 40).cast("double").alias("beta"),
    )
    df.createOrReplaceTempView("hot_beta")
    for n in (1, 3, 1000):
        expected = spark.sql(
            f"""SELECT topic, term, beta FROM (
                  SELECT *, rank() OVER (PARTITION BY topic ORDER BY beta DESC) r FROM hot_beta)
                WHERE r <= {n}"""
        )
        found = ranking.top_n(df, ["topic"], "beta", n)
        assert found.exceptAll(expected).isEmpty() and expected.exceptAll(found).isEmpty()


def test_argmax_takes_the_first_topic_on_a_tie(spark, rows):
    posterior = spark.createDataFrame(
        [("1", 1, 0.2), ("1", 2, 0.4), ("1", 3, 0.4), ("2", 1, 0.5), ("2", 2, 0.5), ("2", 3, 0.0),
         ("3", 1, 0.0), ("3", 2, 0.0), ("3", 3, 0.0)],
        "docid string, topic int, probability double",
    )
    assert rows(ranking.top_topic(posterior)) == [("1", 2, 0.4), ("2", 1, 0.5)]
    ranked = rows(ranking.topics_ranked(posterior).where("docid = '1'"), "rank", "topic")
    assert ranked == [(1, 2), (2, 3), (3, 1)]


def test_label_table_without_a_topic_drops_only_that_topic(spark, rows):
    docs = corpus(spark, "x", "y", "z")
    posterior = spark.createDataFrame(
        [("1", 1, 0.9), ("2", 2, 0.9), ("3", 3, 0.9)], "docid string, topic int, probability double"
    )
    labels = spark.createDataFrame([(1, "one"), (3, "three")], "topic int, label string")
    found = rows(clusters.cluster_documents(docs, posterior, labels), "topic", "label", "docid")
    assert found == [(1, "one", "1"), (3, "three", "3")]


def suggestion_fixture(spark):
    docs = spark.createDataFrame(
        [("1", 1, "crime report out now crime rate"), ("2", 1, "crime rate out now crime report"),
         ("3", 2, "cupboard is bare"), ("4", 3, "nothing here")],
        "docid string, topic int, text string",
    )
    terms = spark.createDataFrame(
        [(1, "missing", 0.5), (1, "crime", 0.3), (1, "out", 0.1), (2, "cup", 0.4), (3, "zebra", 0.4)],
        "topic int, term string, beta double",
    )
    return docs, terms


def test_suggestions_take_the_strongest_matching_term_and_keep_ties(spark, rows):
    docs, terms = suggestion_fixture(spark)
    found = rows(compare.suggest_labels(default_labels(spark, 3), terms, docs, n=2))
    assert found == [(1, "unknown", "crime rate,crime report"), (2, "unknown", "cupboard is")]


def test_suggestions_for_all_topics_and_word_boundary(spark, rows):
    docs, terms = suggestion_fixture(spark)
    kept = rows(
        compare.suggest_labels(
            default_labels(spark, 3), terms, docs, n=2, word_boundary=True, keep_all_topics=True
        ),
        "topic", "suggestions",
    )
    assert kept == [(1, "crime rate,crime report"), (2, None), (3, None)]


def test_ngram_that_matches_two_tied_terms_is_listed_for_both(spark, rows):
    docs = spark.createDataFrame([("1", 1, "cupboard is bare")], "docid string, topic int, text string")
    terms = spark.createDataFrame(
        [(1, "cup", 0.4), (1, "cupboard", 0.4)], "topic int, term string, beta double"
    )
    found = rows(compare.suggest_labels(default_labels(spark, 1), terms, docs), "suggestions")
    assert found == [("cupboard is bare,cupboard is bare",)]


def beta_fixture(spark):
    return spark.createDataFrame(
        [(1, "a", 0.5), (1, "b", 0.25), (1, "c", 0.25), (2, "a", 0.25), (2, "b", 0.5), (2, "c", 0.25),
         (3, "a", 0.125), (3, "b", 0.125)],
        "topic int, term string, beta double",
    )


def test_log_ratio_is_positive_where_the_term_is_stronger_elsewhere(spark, rows):
    beta = beta_fixture(spark)
    # "c" is not in topic 3, so it is not comparable with every other topic.
    assert rows(compare.log_ratio(beta, 1, 3, n=3)) == [
        ("a", 2, -1.0), ("a", 3, -2.0), ("b", 2, 1.0), ("b", 3, -1.0),
    ]
    assert rows(compare.log_ratio(beta, 1, 3, n=1, topic_range=(3, 3))) == [("a", 3, -2.0)]
    wide = compare.log_ratio_matrix(compare.log_ratio(beta, 1, 3, n=3), [2, 3])
    assert rows(wide) == [("a", -1.0, -2.0), ("b", 1.0, -1.0)]


def test_log_ratio_of_a_single_topic_is_empty(spark):
    beta = beta_fixture(spark).where("topic = 1")
    assert compare.log_ratio(beta, 1, 1).isEmpty()


def test_display_order_is_the_mean_over_topics(spark, rows):
    found = dict(rows(ranking.display_order(beta_fixture(spark)), "term", "mean_beta"))
    assert found["c"] == pytest.approx(0.25)


def test_new_texts_get_their_own_ids_and_rows(spark, rows):
    docs = spark.createDataFrame(
        [("9", "apple pear"), ("10", "pear plum")], "docid string, text string"
    )
    counts = tokens.token_counts(docs)
    new = spark.createDataFrame([("apple apple unseen",), ("plum",), ("strange words",)], "text string")
    numbered = weighting.number_new_texts(new, docs).persist()
    assert rows(numbered) == [("11", "apple apple unseen"), ("12", "plum"), ("13", "strange words")]
    fresh = weighting.new_text_counts(numbered, counts)
    assert rows(fresh) == [("11", "apple", 2), ("12", "plum", 1)]
    whole = weighting.select_new(weighting.extended_tf_idf(counts, fresh), numbered)
    fast = weighting.new_text_tf_idf(*weighting.corpus_statistics(counts), fresh)
    assert rows(whole) == rows(fast)
    assert fast.where("docid = '11'").first()["idf"] == pytest.approx(math.log(4 / 2))


def test_equal_new_texts_are_kept(spark):
    docs = corpus(spark, "a")
    new = spark.createDataFrame([("same",), ("same",)], "text string")
    united = weighting.append_texts(docs, weighting.number_new_texts(new, docs))
    assert united.count() == 3 and united.select("docid").distinct().count() == 3


def test_row_ids_are_complete_and_in_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v")).repartition(7)
    ids = with_row_ids(df, "rid", ["v"])
    assert ids.where(F.col("rid") != F.col("v") + 1).isEmpty()
    assert ids.agg(F.count_distinct("rid"), F.min("rid"), F.max("rid")).first()[:] == (5000, 1, 5000)
    unordered = with_row_ids(df, "rid", start=11)
    assert unordered.agg(F.count_distinct("rid"), F.min("rid"), F.max("rid")).first()[:] == (5000, 11, 5010)


def test_row_ids_spread_a_hot_key_and_copies(spark):
    df = spark.range(6000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id")).alias("v"))
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")  # this little data would go into one task
    try:
        ids = with_row_ids(df, "rid", ["v"])
    finally:
        spark.conf.unset(coalesce)
    assert ids.agg(F.count_distinct("rid"), F.min("rid"), F.max("rid")).first()[:] == (6000, 1, 6000)
    assert ids.where("v = 1").agg(F.max("rid")).first()[0] == 4000
    per_task = ids.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert per_task < 2000


def test_largest_id_ignores_what_is_not_a_number(spark):
    df = spark.createDataFrame([("7",), ("12",), ("x",)], "docid string")
    assert largest_id(df) == 12
    assert largest_id(df.where("docid = 'x'")) == 0


def test_splits_are_disjoint_complete_and_stratified(spark):
    docs = spark.createDataFrame(
        [(f"{c}{i}", c) for c, n in (("a", 1), ("b", 2), ("c", 10)) for i in range(n)] + [("n1", None)],
        "docid string, label string",
    )
    found = splits.stratified_split(docs).persist()
    assert found.count() == 13 == found.select("docid").distinct().count()
    sizes = {(r["label"], r["split"]): r["count"] for r in found.groupBy("label", "split").count().collect()}
    assert sizes == {
        ("a", "train"): 1, ("b", "train"): 2,
        ("c", "train"): 6, ("c", "validation"): 2, ("c", "test"): 2,
    }


def test_split_of_a_hot_class_equals_row_number(spark):
    docs = spark.range(20_000).select(
        F.col("id").cast("string").alias("docid"),
        F.when(F.col("id") % 5 < 3, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 97)).alias("label"),
    )
    docs.withColumn("k", splits.split_key(7)).createOrReplaceTempView("to_split")
    expected = spark.sql(
        """SELECT docid, label,
                  CASE WHEN r <= ceil(0.7D * n) THEN 'train' WHEN r <= ceil(0.85D * n) THEN 'validation'
                       ELSE 'test' END AS split
           FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY k) r,
                        count(*) OVER (PARTITION BY label) n FROM to_split)"""
    )
    for digits in (1, 4):
        found = splits.stratified_split(docs, fractions=(0.7, 0.15, 0.15), seed=7, bucket_digits=digits)
        assert found.count() == 20_000
        assert found.exceptAll(expected).isEmpty()


def test_copies_of_an_id_share_a_split(spark):
    docs = spark.range(3000).select(
        F.when(F.col("id") < 1000, "same").otherwise(F.col("id").cast("string")).alias("docid"),
        F.lit("x").alias("label"),
    )
    found = splits.stratified_split(docs)
    assert found.count() == 3000
    assert found.where("docid = 'same'").select("split").distinct().count() == 1


def test_class_shares_add_up(spark):
    docs = spark.range(100).select(F.col("id").cast("string").alias("docid"), (F.col("id") % 3).alias("label"))
    shares = splits.class_shares(splits.stratified_split(docs))
    totals = shares.groupBy("split").agg(F.sum("pc").alias("s")).collect()
    assert len(totals) == 3 and all(r["s"] == pytest.approx(1.0) for r in totals)


def test_one_hot_keeps_all_classes_or_drops_the_first(spark, rows):
    df = spark.createDataFrame([("1", "b"), ("2", "a"), ("3", None)], "docid string, label string")
    assert rows(features.one_hot_labels(df), "docid", "class", "indicator") == [
        ("1", "a", 0), ("1", "b", 1), ("2", "a", 1), ("2", "b", 0),
    ]
    assert rows(features.one_hot_labels(df, drop_first=True), "docid", "class", "indicator") == [
        ("1", "b", 1), ("2", "b", 0),
    ]


def test_the_vocabulary_has_every_word_in_order(spark, rows):
    counts = spark.createDataFrame(
        [("1", "a", 5), ("2", "a", 1), ("1", "d", 2), ("1", "c", 2), ("2", "b", 2), ("2", "e", 1)],
        "docid string, word string, n long",
    )
    assert features.fit_counter(counts).vocabulary == list("abcde")
    assert rows(features.word_totals(counts), "word", "total", "df")[0] == ("a", 6, 2)


def test_features_drop_incomplete_rows(spark, rows):
    weights = spark.createDataFrame(
        [("1", "a", 0.5), ("2", "b", 0.1), ("3", "c", None)], "docid string, word string, tf_idf double"
    )
    labelled = spark.createDataFrame([("1", "x"), ("2", None), ("3", "y")], "docid string, label string")
    assert rows(features.labelled_features(weights, labelled)) == [("1", "a", 0.5, "x")]


def test_related_documents_are_listed_once(spark, rows):
    clustered = spark.createDataFrame(
        [(1, "l", "1", "t", 0.9), (1, "l", "2", "t", 0.8), (2, "m", "3", "t", 0.7)],
        "topic int, label string, docid string, text string, probability double",
    )
    predicted = spark.createDataFrame([(1,), (1,), (None,)], "topic int")
    assert rows(clusters.related_documents(clustered, predicted), "docid") == [("1",), ("2",)]
    assert rows(clusters.in_topic(clustered, 2), "docid") == [("3",)]
    assert clusters.in_topic(clustered).count() == 3
    assert rows(clusters.cluster_sizes(clustered)) == [(1, "l", 2, "1 l"), (2, "m", 1, "2 m")]


def test_history_tables(spark, rows):
    history = spark.createDataFrame(
        [(1, "training", "loss", 0.5), (1, "training", "accuracy", 0.7), (1, "validation", "loss", 0.6),
         (1, "validation", "accuracy", 0.65), (2, "training", "loss", 0.4)],
        "epoch int, data string, metric string, value double",
    )
    assert rows(classifier.history_by_epoch(history)) == [(1, 0.5, 0.7, 0.6, 0.65)]
    assert rows(classifier.history_of(history, "training")) == [(1, 0.5, 0.7), (2, 0.4, None)]


def test_histogram_is_right_closed_and_lists_empty_bins(spark, rows):
    df = spark.createDataFrame([(x,) for x in (0.0, 1.0, 2.0, 2.5, 10.0, None)], "x double")
    assert rows(histogram(df, "x", 5), "bin", "n") == [(1, 3), (2, 1), (3, 0), (4, 0), (5, 1)]
    assert rows(histogram(df.where("x = 1"), "x", 2), "bin", "n") == [(1, 1), (2, 0)]


def test_topic_pages(spark):
    assert parse_page("11..20") == (11, 20)
    with pytest.raises(ValueError):
        parse_page("11-20")
    pages = [r[0] for r in spark.range(9, 12).select(page_of(F.col("id"))).collect()]
    assert pages == ["1..10", "1..10", "11..20"]


def test_prefix_is_stripped_once(spark):
    df = spark.createDataFrame([("label.label.x",)], "v string")
    assert df.select(strip_prefix(F.col("v"), "label.")).first()[0] == "label.x"


def test_preview_needs_an_order(spark, rows):
    df = spark.range(10)
    assert rows(tokens.head(df, 2, "id")) == [(0,), (1,)]
    with pytest.raises(ValueError):
        tokens.head(df, 2)
