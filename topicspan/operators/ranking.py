"""Top-n and group maxima with ties kept, argmax, ranked lists.

Groups here are topics or classes: few and large. Nothing below collects a
group in one task. Each operator first reduces the groups to one threshold
each, with a combine before the shuffle, and then filters the rows in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicspan.functions import page_of
from topicspan.session import sized


def group_max(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows that carry the maximum of their group, all of them on a tie.

    ``df`` is read twice; persist it if it is expensive.
    """
    best = df.groupBy(*keys).agg(F.max(value).alias("__best"))
    return (
        df.join(sized(best), list(keys)).where(F.col(value) == F.col("__best")).select(*df.columns)
    )


def top_n(df: DataFrame, keys: Sequence[str], value: str, n: int) -> DataFrame:
    """The rows whose rank by ``value`` is at most ``n``; ties are kept.

    Rows with equal values are counted, not gathered, so a group full of ties
    costs no more than any other. ``df`` is read twice; persist it if it is
    expensive.
    """
    steps = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__ties"))
    down = Window.partitionBy(*keys).orderBy(F.desc(value))
    leading = steps.withColumn("__step", F.row_number().over(down)).where(F.col("__step") <= n)
    above = F.sum("__ties").over(down) - F.col("__ties")
    cut = (
        leading.withColumn("__above", above)
        .where(F.col("__above") < n)
        .groupBy(*keys)
        .agg(F.min(value).alias("__cut"))
    )
    return df.join(sized(cut), list(keys)).where(F.col(value) >= F.col("__cut")).select(*df.columns)


def top_terms(beta: DataFrame, n: int = 10) -> DataFrame:
    """(topic, term, beta): the most probable terms of each topic."""
    return top_n(beta.select("topic", "term", "beta"), ["topic"], "beta", n)


def by_strength(terms: DataFrame) -> DataFrame:
    """Sort for display: topic, strongest term first, then the term itself."""
    return terms.orderBy("topic", F.desc("beta"), "term")


def in_topic_range(df: DataFrame, first: int, last: int) -> DataFrame:
    return df.where(F.col("topic").between(first, last))


def other_topics(df: DataFrame, start: int) -> DataFrame:
    return df.where(F.col("topic") != start)


def paged(df: DataFrame, size: int = 10) -> DataFrame:
    """Add the caption of the page on which a topic is listed."""
    return df.withColumn("page", page_of(F.col("topic"), size))


def display_order(terms: DataFrame) -> DataFrame:
    """Order terms by their mean beta over the topics that list them.

    A term has at most one row per topic, so its window is small.
    """
    mean = F.avg("beta").over(Window.partitionBy("term"))
    return terms.withColumn("mean_beta", mean)


def top_topic(posterior: DataFrame) -> DataFrame:
    """(docid, topic, probability): most probable topic, first one on a tie.

    One aggregate with a combine before the shuffle; no sort, no self join.
    Documents without any positive probability have no topic and drop out.
    """
    best = F.max(F.struct(F.col("probability"), (-F.col("topic")).alias("lower")))
    return (
        posterior.where(F.col("probability") > 0)
        .groupBy("docid")
        .agg(best.alias("b"))
        .select("docid", (-F.col("b.lower")).alias("topic"), F.col("b.probability").alias("probability"))
    )


def topics_ranked(posterior: DataFrame) -> DataFrame:
    """All topics of each document with their rank, most probable first.

    A document has k rows, so its window is small.
    """
    order = Window.partitionBy("docid").orderBy(F.desc("probability"), "topic")
    return posterior.withColumn("rank", F.row_number().over(order))
