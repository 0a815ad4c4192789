"""From texts to token and n-gram tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicspan.functions import word_array, word_runs
from topicspan.operators.lookup import frequent_keys, look_up
from topicspan.session import sized

# Text of one task of ``document_counts``, in bytes: a few million counted words.
TASK_BYTES = 32 << 20


@cache
def english_stop_words() -> tuple[str, ...]:
    """The English stop word list shipped with Spark ML (needs a session)."""
    return tuple(StopWordsRemover.loadDefaultStopWords("english"))


def words(corpus: DataFrame, keep: Sequence[str] = ("docid",)) -> DataFrame:
    """One row per word of each text, with the columns ``keep``."""
    return corpus.select(*keep, F.explode(word_array("text")).alias("word"))


def without_stop_words(
    tokens: DataFrame, stop_words: Sequence[str] | DataFrame | None = None
) -> DataFrame:
    """Drop stop words, given as a list or as a table with a ``word`` column.

    A list becomes a hash-set predicate in the scan stage; a table becomes an
    anti join, broadcast or shuffled by its size.
    """
    if isinstance(stop_words, DataFrame):
        listed = sized(stop_words.select("word").distinct())
        return tokens.join(listed, "word", "left_anti").select(*tokens.columns)
    listed = english_stop_words() if stop_words is None else tuple(stop_words)
    return tokens.where(~F.col("word").isin(*listed)) if listed else tokens


def token_counts(
    corpus: DataFrame, stop_words: Sequence[str] | DataFrame | None = None
) -> DataFrame:
    """(docid, word, n) without stop words. Counted per task before the shuffle."""
    return (
        without_stop_words(words(corpus), stop_words)
        .groupBy("docid", "word")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def document_counts(corpus: DataFrame, stop_words: Sequence[str] | None = None) -> DataFrame:
    """(docid, word, n, total): :func:`token_counts` and the words of the whole document.

    Texts are shuffled in place of the words they are made of, and to tasks of
    bounded size: each counts its documents without a further exchange. Ids that
    very many rows share, null too, are counted word by word instead. ``corpus``
    is read three times: its ids, the sizes of its texts, its texts.
    """
    listed = english_stop_words() if stop_words is None else tuple(stop_words)
    texts = corpus.select("docid", "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = texts.groupBy("docid").agg(F.count(F.lit(1)).alias("__rows"))
    shared = sized(frequent_keys(ids, "__rows").where("__rows > 1").select(F.col("docid").alias("__id")))
    some = not shared.isEmpty()
    own = texts.join(F.broadcast(shared), _same_id(), "left_anti") if some else texts
    read = own.repartition(max(tasks, -(-size // TASK_BYTES)), "docid").select(
        "docid", _without(word_array("text"), listed).alias("__words")
    )
    length = F.coalesce(F.size("__words"), F.lit(0)).cast("long")
    counts = (
        read.withColumn("total", F.sum(length).over(Window.partitionBy("docid")))
        .select("docid", "total", F.explode("__words").alias("word"))
        .groupBy("docid", "word", "total")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("docid", "word", "n", "total")
    )
    if not some:
        return counts
    copied = token_counts(texts.join(F.broadcast(shared), _same_id(), "left_semi"), listed)
    totals = copied.groupBy(F.col("docid").alias("__id")).agg(F.sum("n").alias("total"))
    return counts.unionByName(
        copied.join(F.broadcast(totals), _same_id()).select("docid", "word", "n", "total")
    )


def _same_id() -> Column:
    return F.col("docid").eqNullSafe(F.col("__id"))


def _without(words: Column, listed: Sequence[str]) -> Column:
    return F.filter(words, lambda w: ~w.isin(*listed)) if listed else words


def vocabulary(tokens: DataFrame) -> DataFrame:
    """The distinct words of a token table."""
    return tokens.select("word").distinct()


def known_words_only(tokens: DataFrame, known: DataFrame) -> DataFrame:
    """Keep the words that a model has seen.

    Frequent words of ``tokens``, known or not, do not enter the shuffle key.
    """
    flags = known.select("word").distinct().withColumn("__seen", F.lit(True))
    rows = F.count_if(F.col("n") > 0) if "n" in tokens.columns else F.count(F.lit(1))
    frequent = frequent_keys(tokens.groupBy("word").agg(rows.alias("__rows")), "__rows")
    hot = F.broadcast(frequent.select("word")).join(flags, "word", "left").select(
        "word", F.coalesce("__seen", F.lit(False)).alias("__seen")
    )
    found = look_up(tokens, flags, hot, "word", ["__seen"], spread_by="docid")
    return found.where(F.col("__seen")).select(*tokens.columns)


def ngrams(corpus: DataFrame, n: int = 3, keep: Sequence[str] = ("topic",)) -> DataFrame:
    """One row per n-gram of each text; stop words stay in. No shuffle."""
    read = corpus.select(*keep, word_array("text").alias("__words"))
    runs = read.select(*keep, F.explode(word_runs("__words", n)).alias("__run"))
    return runs.select(*keep, F.concat_ws(" ", *[f"__run.w{i}" for i in range(n)]).alias("bigram"))


def ngram_counts(corpus: DataFrame, n: int = 3, by: Sequence[str] = ("topic",)) -> DataFrame:
    """(bigram, topic, n): how often an n-gram occurs in the texts of a topic.

    The column is named ``bigram`` for every ``n``.
    """
    return ngrams(corpus, n, by).groupBy("bigram", *by).agg(F.count(F.lit(1)).alias("n"))


def rows_per_topic(df: DataFrame, name: str = "n") -> DataFrame:
    """How many rows a topic has in ``df``."""
    return df.groupBy("topic").agg(F.count(F.lit(1)).alias(name))


def corpus_totals(tokens: DataFrame, corpus: DataFrame, label: str = "appTag") -> DataFrame:
    """One row: documents with tokens, distinct words, distinct classes.

    Three separate distinct counts; in one aggregate they would copy every
    row three times.
    """
    documents = tokens.select("docid").distinct().agg(F.count(F.lit(1)))
    features = tokens.select("word").distinct().agg(F.count(F.lit(1)))
    classes = corpus.select(label).where(F.col(label).isNotNull()).distinct().agg(F.count(F.lit(1)))
    return tokens.sparkSession.range(1).select(
        documents.scalar().alias("documents"),
        features.scalar().alias("features"),
        classes.scalar().alias("classes"),
    )


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in an explicit order."""
    if not order:
        raise ValueError("a preview needs an order; Spark rows have none of their own")
    return df.orderBy(*order).limit(n)
