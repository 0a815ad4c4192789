"""Unsmoothed TF-IDF: tf = n / document total, idf = ln(N / df)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicspan.operators.ids import largest_id, with_row_ids
from topicspan.operators.lookup import COMMON_PARTS, frequent_keys, look_up, look_up_apart
from topicspan.operators.tokens import known_words_only, token_counts

TF_IDF_COLUMNS = ("docid", "word", "n", "tf", "idf", "tf_idf")


def document_totals(counts: DataFrame) -> DataFrame:
    """(docid, total, words): words and distinct words of each document."""
    return counts.groupBy("docid").agg(
        F.sum("n").alias("total"), F.count_if(F.col("n") > 0).alias("words")
    )


def document_frequencies(counts: DataFrame) -> DataFrame:
    """(word, df) documents each word occurs in.

    The condition on ``n`` keeps that column in the plan, so that this branch
    reads the very shuffle output the other branches of TF-IDF read.
    """
    return counts.groupBy("word").agg(F.count_if(F.col("n") > 0).alias("df"))


def _shared(counts: DataFrame) -> DataFrame:
    """Conditions that joins would add to some branches of a plan only, and
    that would keep their shuffles from being shared."""
    return counts.where(F.col("docid").isNotNull() & F.col("word").isNotNull())


def tf_idf(counts: DataFrame) -> DataFrame:
    """(docid, word, n, tf, idf, tf_idf).

    Totals and document frequencies are aggregates joined back, not windows:
    a window would pull all rows of a frequent word into one task, whereas an
    aggregate combines before the shuffle. The joins take frequent words, and
    very long documents, out of the shuffle key.

    Counts that have ``total``, as :func:`tokens.document_counts` gives them, are
    stored: they are read twice, and only rows of rarer words are shuffled.
    """
    counts = _shared(counts)
    if "total" in counts.columns:
        return _tf_idf_stored(counts)
    totals = document_totals(counts)
    frequencies = document_frequencies(counts)
    documents = totals.agg(F.count_if(F.col("total") > 0)).scalar()
    with_total = look_up(
        counts, totals, frequent_keys(totals, "words"), "docid", ["total"], spread_by="word"
    )
    with_both = look_up(
        with_total, frequencies, frequent_keys(frequencies, "df"), "word", ["df"], spread_by="docid"
    )
    return _weighted(with_both, documents, F.col("df"))


def _tf_idf_stored(counts: DataFrame) -> DataFrame:
    frequencies = document_frequencies(counts)
    common = frequent_keys(frequencies, "df", COMMON_PARTS)
    documents = document_totals(counts).agg(F.count_if(F.col("total") > 0)).scalar()
    return _weighted(look_up_apart(counts, frequencies, common, "word", ["df"]), documents, F.col("df"))


def _weighted(rows: DataFrame, documents: Column, df: Column) -> DataFrame:
    return (
        rows.select("docid", "word", "n", F.col("n") / F.col("total"), F.log(documents / df))
        .toDF("docid", "word", "n", "tf", "idf")
        .withColumn("tf_idf", F.col("tf") * F.col("idf"))
    )


def number_new_texts(
    new_texts: DataFrame, corpus: DataFrame, order_by: Sequence[str] = ("text",)
) -> DataFrame:
    """(docid, text) for texts to add; ids continue after the corpus."""
    numbered = with_row_ids(
        new_texts.select(*dict.fromkeys(["text", *order_by])),
        "docid",
        order_by,
        start=largest_id(corpus) + 1,
    )
    return numbered.select(F.col("docid").cast("string").alias("docid"), "text")


def append_texts(corpus: DataFrame, numbered: DataFrame) -> DataFrame:
    """Corpus and new texts in one table; equal texts are kept."""
    return corpus.select("docid", "text").unionByName(numbered.select("docid", "text"))


def corpus_statistics(counts: DataFrame) -> tuple[DataFrame, int]:
    """(word, df) of a corpus, persisted, and its number of documents.

    All that later texts need to be weighted. ``counts`` is read twice; pass
    the stored token table.
    """
    frequencies = document_frequencies(counts).persist(StorageLevel.MEMORY_AND_DISK)
    return frequencies, counts.select("docid").distinct().count()


def new_text_counts(
    numbered: DataFrame,
    known: DataFrame,
    stop_words: Sequence[str] | DataFrame | None = None,
) -> DataFrame:
    """Token counts of new texts over known words (a table with ``word``)."""
    return known_words_only(token_counts(numbered, stop_words), known)


def select_new(rows: DataFrame, numbered: DataFrame) -> DataFrame:
    """Keep the rows of the newly added documents, however many there are."""
    return rows.join(numbered.select("docid"), "docid", "left_semi").select(*rows.columns)


def extended_tf_idf(counts: DataFrame, new_counts: DataFrame) -> DataFrame:
    """TF-IDF over the corpus and the new texts together.

    The corpus is not tokenised again; its counts are reused. Where they have
    ``total``, no document may be in both tables.
    """
    if "total" in counts.columns and "total" not in new_counts.columns:
        totals = document_totals(new_counts)
        new_counts = look_up(
            new_counts, totals, frequent_keys(totals, "words"), "docid", ["total"], spread_by="word"
        )
    return tf_idf(counts.unionByName(new_counts))


def new_text_tf_idf(frequencies: DataFrame, documents: int, new_counts: DataFrame) -> DataFrame:
    """The rows of :func:`extended_tf_idf` that belong to new texts.

    The corpus enters by its statistics only: df and N of the union are sums,
    since no document is in both tables.
    """
    new_counts = _shared(new_counts)
    totals = document_totals(new_counts)
    added = document_frequencies(new_counts).withColumnRenamed("df", "added")
    united = F.lit(documents) + totals.agg(F.count_if(F.col("total") > 0)).scalar()
    # One row per word: only the words of the new texts are looked up.
    sums = added.join(frequencies, "word").select("word", "added", (F.col("df") + F.col("added")).alias("df"))
    with_total = look_up(
        new_counts, totals, frequent_keys(totals, "words"), "docid", ["total"], spread_by="word"
    )
    with_both = look_up(
        with_total, sums, frequent_keys(sums, "added"), "word", ["df"], spread_by="docid"
    )
    return _weighted(with_both, united, F.col("df"))
