"""What the plans promise for large and skewed data."""

from __future__ import annotations

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from topicspan import session
from topicspan.operators import compare, ranking, splits, tokens, weighting
from topicspan.plans.tables import documents, with_topic


@contextmanager
def settings(spark, **values):
    names = {k: f"spark.sql.{k.replace('__', '.')}" for k in values}
    before = {n: spark.conf.get(n) for n in names.values()}
    for k, v in values.items():
        spark.conf.set(names[k], v)
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tf_idf_reads_one_token_shuffle(spark, sf_dir):
    df = weighting.tf_idf(tokens.token_counts(documents(spark, sf_dir)))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final, in_final = [], True
    for line in plan.splitlines():
        if "== Final Plan ==" in line:
            in_final = True
        elif "== Initial Plan ==" in line:
            in_final = False
        elif in_final:
            final.append(line)
    assert sum("ReusedExchange" in line for line in final) >= 3
    assert sum("FileScan" in line for line in final) <= 1


def test_only_needed_columns_are_read(spark, sf_dir):
    labelled = documents(spark, sf_dir).select("docid", F.col("appTag").alias("label"))
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in planned(splits.stratified_split(labelled))
    counts = tokens.token_counts(documents(spark, sf_dir))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in planned(counts)


def test_counts_are_combined_before_the_shuffle(spark, sf_dir):
    corpus = with_topic(documents(spark, sf_dir))
    for df in (tokens.token_counts(corpus), tokens.ngram_counts(corpus)):
        assert "partial_count" in planned(df)


def largest_task(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_frequent_words_are_spread_over_tasks(spark):
    docs = spark.range(0, 30_000, 1, 8).select(
        F.col("id").cast("string").alias("docid"), F.concat(F.lit("hot w"), F.col("id")).alias("text")
    )
    with settings(
        spark,
        autoBroadcastJoinThreshold="-1",
        adaptive__coalescePartitions__enabled="false",
        shuffle__partitions="16",
    ):
        counts = tokens.token_counts(docs, [])
        df = weighting.tf_idf(counts)
        assert df.count() == 60_000
        assert df.where("word = 'hot'").agg(F.max("idf"), F.count("*")).first()[:] == (0.0, 30_000)
        assert largest_task(df) < 8_000
        known = spark.createDataFrame([("w1",)], "word string")
        assert tokens.known_words_only(counts, known).count() == 1
        hot = tokens.known_words_only(counts, spark.createDataFrame([("hot",), ("hot",)], "word string"))
        assert hot.count() == 30_000 and largest_task(hot) < 4_000


def test_a_document_with_a_third_of_all_rows_is_spread(spark):
    long_text = " ".join(f"w{i}" for i in range(10_000))
    docs = spark.range(0, 2_000, 1, 8).select(
        F.col("id").cast("string").alias("docid"),
        F.when(F.col("id") == 0, long_text)
        .otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.concat(F.lit("v"), F.col("id"), F.lit("x"), i)), " "))
        .alias("text"),
    )
    with settings(
        spark,
        autoBroadcastJoinThreshold="-1",
        adaptive__coalescePartitions__enabled="false",
        shuffle__partitions="16",
    ):
        df = weighting.tf_idf(tokens.token_counts(docs, []))
        assert df.where("docid = '0'").agg(F.count("*"), F.min("tf"), F.max("tf")).first()[:] == (
            10_000, 1 / 10_000, 1 / 10_000,
        )
        assert df.count() == 10_000 + 1_999 * 10
        assert largest_task(df) < 5_000


def test_no_row_level_window_by_topic(spark):
    beta = spark.range(1000).select(
        (F.col("id") % 3 + 1).cast("int").alias("topic"),
        F.col("id").cast("string").alias("term"),
        (1.0 / (F.col("id") + 1)).alias("beta"),
    )
    for df in (ranking.top_terms(beta, 5), ranking.group_max(beta, ["topic"], "beta")):
        before_the_cut = planned(df).split("InMemoryRelation")[0]
        assert "Window" not in before_the_cut
        assert "Exchange hashpartitioning(topic" not in before_the_cut


def test_ngrams_are_filtered_before_they_are_counted(spark, sf_dir):
    corpus = with_topic(documents(spark, sf_dir))
    terms = spark.createDataFrame([(1, "la", 0.5), (2, "the", 0.5)], "topic int, term string, beta double")
    plan = planned(compare.term_ngrams(terms, corpus))
    assert plan.index("partial_count") < plan.index("StartsWith(bigram")
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_results_do_not_depend_on_broadcasts(spark, sf_dir, rows):
    corpus = with_topic(documents(spark, sf_dir))
    terms = spark.createDataFrame([(1, "d", 0.5), (2, "th", 0.5)], "topic int, term string, beta double")
    usual = rows(compare.term_ngrams(terms, corpus))
    with settings(spark, autoBroadcastJoinThreshold="-1"):
        df = compare.term_ngrams(terms, corpus)
        assert "BroadcastHashJoin" not in planned(df)
        assert rows(df) == usual


class _Remote:
    """A session on a cluster that names no shared folder."""

    class conf:
        get = staticmethod(lambda name, default: default)

    class sparkContext:
        master = "yarn"


def test_a_cluster_must_name_its_shared_folder(spark):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(_Remote)
    assert session.scratch_path(spark, "a").startswith(session.shared_dir(spark))
    assert session.scratch_path(spark, "a") != session.scratch_path(spark, "a")
