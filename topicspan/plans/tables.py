"""Relations that the registered queries share.

Operators take tables, never model objects. Languages and sources of the
given documents therefore stand in for topics where a query must be checked
row for row: beta and posterior built from them have the schema, and the
properties, of those a topic model gives.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspan.functions import softmax
from topicspan.operators.lookup import COMMON_PARTS, frequent_keys, look_up_apart
from topicspan.operators.tokens import document_counts, token_counts, without_stop_words, words
from topicspan.operators.weighting import document_frequencies, number_new_texts
from topicspan.session import sized, spread, stored
from topicspan.sources.corpus import define_corpus

DIGITS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, label: str = "lang") -> DataFrame:
    """The corpus: docid, text, appTag."""
    source = spread(table(spark, sf_dir, "documents").select("doc_id", "text", label))
    return define_corpus(source, "text", label, "doc_id")


def short_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(docid, text) of every conversation turn."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(F.concat_ws("-", "conv_id", "turn").alias("docid"), "text")


def new_texts(spark: SparkSession, sf_dir: str, corpus: DataFrame) -> DataFrame:
    """(docid, text) of the benchmark items, numbered after the corpus."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return number_new_texts(items, corpus, ["item_id"])


def class_count(corpus: DataFrame) -> int:
    return corpus.agg(F.count_distinct("appTag")).first()[0]


def with_topic(corpus: DataFrame) -> DataFrame:
    """Number the classes of a corpus alphabetically and call them topics."""
    classes = corpus.select("appTag").agg(F.array_sort(F.collect_set("appTag"))).scalar()
    return corpus.withColumn("topic", F.array_position(classes, F.col("appTag")).cast("int"))


def stand_in_beta(topical: DataFrame, topics: int) -> DataFrame:
    """(topic, term, beta) with add-one smoothing, persisted.

    Every topic has every term, as in a topic model. One aggregate per word
    counts all topics at once, so no word meets a topic in a join.
    """
    per_word = (
        without_stop_words(words(topical, ("topic",)))
        .groupBy("word")
        .agg(*[F.count_if(F.col("topic") == t).alias(f"t{t}") for t in range(1, topics + 1)])
    )
    counted = per_word.select(
        F.col("word").alias("term"),
        F.posexplode(F.array(*[f"t{t}" for t in range(1, topics + 1)])).alias("__i", "n"),
    ).select((F.col("__i") + 1).alias("topic"), "term", "n").persist(StorageLevel.MEMORY_AND_DISK)
    totals = counted.groupBy("topic").agg((F.sum("n") + F.count(F.lit(1))).alias("__all"))
    return (
        counted.join(sized(totals), "topic")
        .select("topic", "term", ((F.col("n") + 1) / F.col("__all")).alias("beta"))
        .persist(StorageLevel.MEMORY_AND_DISK)
    )


def stand_in_posterior(counts: DataFrame, beta: DataFrame, topics: int) -> DataFrame:
    """(docid, topic, probability): softmax over topics of sum n * ln(beta).

    Beta is joined as one row per word, so a token row meets one row. ``counts``
    are stored, and read twice: the rows of common words are added up for each
    document before any shuffle.
    """
    wide = beta.groupBy("term").agg(
        *[F.max(F.when(F.col("topic") == t, F.log("beta"))).alias(f"b{t}") for t in range(1, topics + 1)]
    )
    wide = wide.withColumnRenamed("term", "word")
    common = frequent_keys(document_frequencies(counts), "df", COMMON_PARTS).select("word")
    logs = [f"b{t}" for t in range(1, topics + 1)]
    scores = (
        look_up_apart(counts, wide, common.join(wide, "word", "left"), "word", logs)
        .where(F.col("b1").isNotNull())
        .groupBy("docid")
        .agg(*[F.sum(F.col("n") * F.col(f"b{t}")).alias(f"s{t}") for t in range(1, topics + 1)])
        .select("docid", F.array(*[f"s{t}" for t in range(1, topics + 1)]).alias("scores"))
    )
    return scores.select(
        "docid", F.posexplode(softmax(F.col("scores"))).alias("__i", "p")
    ).select("docid", (F.col("__i") + 1).alias("topic"), F.round("p", DIGITS).alias("probability"))


def language_topics(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Corpus with topics, token counts, beta, and the number of topics."""
    corpus = with_topic(documents(spark, sf_dir))
    topics = class_count(corpus)
    return corpus, token_counts(corpus), stand_in_beta(corpus, topics), topics


def language_posterior(
    spark: SparkSession, sf_dir: str
) -> tuple[DataFrame, DataFrame, DataFrame, int, DataFrame]:
    """:func:`language_topics` with stored counts, and the stored posterior of its documents."""
    corpus, _, beta, topics = language_topics(spark, sf_dir)
    counts = stored(document_counts(corpus), "token-counts")
    posterior = stored(stand_in_posterior(counts, beta, topics), "posterior")
    return corpus, counts, beta, topics, posterior
