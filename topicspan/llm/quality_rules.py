"""Quality rules whose thresholds come from the data.

Every text is measured once. Per language, and per language and source, the
measures go into mergeable quantile sketches: counts of values with six
significant bits, which add up in any order. Fences follow from the quartiles
of the sketches and are joined back to the rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from topicspan.llm.common import WORD, stored, texts_of, with_columns_of

# Symbols that are counted, and the length of a repeated window.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
# Base rules: a text has so many words at least, and so much of it repeats at most.
LEAST_WORDS = 20
MOST_REPEATED = 30
# Bits that a sketch keeps of a value: an error of 1/32 at most.
BITS = 6
# How far above the median a text may lie, in distances from the lower quartile to
# the median. Bad texts lie above, so this half of the values is clean even where
# nearly half of the texts are bad.
FENCE = 3
# Measures per 10,000, and the least such distance that counts for each.
RATES: dict[str, tuple[str, int]] = {
    "symbol_rate": ("10000 * n_symbols div greatest(n_words, 1)", 1000),
    "bang_rate": ("10000 * n_bangs div greatest(n_words, 1)", 1000),
    "capital_rate": ("10000 * n_capitals div greatest(word_chars, 1)", 800),
    "length_rate": ("10000 * word_chars div greatest(n_words, 1)", 10000),
    "line_rate": ("10000 * n_dup_lines div greatest(n_words, 1)", 500),
    "repeat_rate": ("10000 * n_repeat_words div greatest(n_words, 1)", 1000),
    "stutter_rate": ("10000 * n_stutters div greatest(n_words, 1)", 500),
}

_MEASURES = [
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_bangs",
    "n_capitals",
    "n_stutters",
]
_word = re.compile(WORD)
_space = re.compile("[^\x20\x09-\x0d]")


def repeated_words(words: Sequence[str], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` (a power of two) words that occur twice or more.

    Windows of 1, 2, 4, ... words are numbered one after the other; a window of
    2n words is a pair of numbers.
    """
    n = len(words)
    if n <= window:
        return 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    size = 1
    while True:
        if len(ids) == 0 or size > window:
            return 0
        _, ids, counts = np.unique(ids, return_inverse=True, return_counts=True)
        if counts.max() == 1:
            return 0
        if size == window:
            break
        ids = ids[: len(ids) - size] * np.int64(len(counts)) + ids[size:]
        size *= 2
    starts = np.flatnonzero(counts[ids] > 1)
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges)[:n] > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if _space.search(line)]
    return len(lines) - len(set(lines))


def measure_text(text: str) -> list[int]:
    words = _word.findall(text)
    ascii_bytes = np.frombuffer(text.encode(), dtype=np.uint8)
    return [
        len(words),
        sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        duplicate_lines(text),
        repeated_words(words),
        text.count("!"),
        int(((ascii_bytes >= 65) & (ascii_bytes <= 90)).sum()),
        sum(map(eq, words, words[1:])),
    ]


def measured(docs: DataFrame, text: Column, keep: Sequence[Column]) -> DataFrame:
    """``keep`` columns and the measures of each whole text; null has no words."""
    chosen = docs.select(*keep, text.alias("__text"))

    def maker():
        def measure(batch: pa.RecordBatch) -> list:
            rows = [measure_text(t) for t in texts_of(batch, "__text")]
            return list(zip(*rows, strict=True)) if rows else [[] for _ in _MEASURES]

        return measure

    fields = [StructField(m, LongType()) for m in _MEASURES]
    return with_columns_of(chosen, chosen.columns[:-1], fields, maker)


def sketch(rows: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """(groups, bucket, rows): counts per bucket, which merge by adding up.

    A bucket keeps the first ``BITS`` bits of a value, so a group has a bounded
    number of them, whatever its number of rows.
    """
    shift = F.greatest(F.length(F.bin(F.col(value))) - F.lit(BITS), F.lit(0))
    return (
        rows.withColumn("__shift", shift)
        .withColumn("bucket", F.expr(f"shiftleft(shiftright({value}, __shift), __shift)"))
        .groupBy(*groups, "bucket")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def merged(sketches: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Coarser sketches from finer ones."""
    return sketches.groupBy(*groups, "bucket").agg(F.sum("rows").alias("rows"))


def fences(sketches: DataFrame, groups: Sequence[str], least: Column) -> DataFrame:
    """(groups, fence): the median plus ``FENCE`` distances from the lower quartile to it."""
    every = Window.partitionBy(*groups)
    upto = every.orderBy("bucket")
    ranked = sketches.withColumn("__upto", F.sum("rows").over(upto)).withColumn(
        "__all", F.sum("rows").over(every)
    )

    def quartile(q: int) -> Column:
        return F.min(F.when(4 * F.col("__upto") >= q * F.col("__all"), F.col("bucket")))

    spread = F.greatest(F.col("__q2") - F.col("__q1"), least)
    return (
        ranked.groupBy(*groups)
        .agg(quartile(1).alias("__q1"), quartile(2).alias("__q2"))
        .select(*groups, (F.col("__q2") + FENCE * spread).alias("fence"))
    )


def rules(rows: DataFrame, lang: str, source: str) -> DataFrame:
    """Add base_failed and kept to measured ``rows``.

    The base rules are those above. A text that passes them is kept unless one
    of its rates lies above the fence of its language and also above that of
    its language and source: a source may differ from its language, and a
    source of few rows does not judge alone. Only texts that pass the base rules
    enter the sketches. Null languages and sources are groups of their own.
    """
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )
    judged = rows.withColumn("base_failed", failed)
    rated = judged.where("NOT base_failed").select(
        F.col(lang).alias("__lang"),
        F.col(source).alias("__source"),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("rate"), F.expr(rate).alias("value"))
                    for name, (rate, _) in RATES.items()
                ]
            )
        ).alias("__r"),
    ).select("__lang", "__source", "__r.rate", "__r.value")
    least = F.coalesce(
        *[F.when(F.col("rate") == name, F.lit(low)) for name, (_, low) in RATES.items()]
    )
    fine = stored(sketch(rated, ["__lang", "__source", "rate"], "value"), "quality-sketch")
    names = list(RATES)

    def wide(sketches: DataFrame, groups: list[str], mark: str) -> DataFrame:
        by_rate = fences(sketches, [*groups, "rate"], least.alias("least"))
        return by_rate.groupBy(*groups).agg(
            *[F.max(F.when(F.col("rate") == n, F.col("fence"))).alias(f"__{mark}_{n}") for n in names]
        )

    per_source = wide(fine, ["__lang", "__source"], "s").withColumnRenamed("__lang", "__l2")
    per_lang = wide(merged(fine, ["__lang", "rate"]), ["__lang"], "l")
    known = stored(
        per_source.join(per_lang, F.col("__l2").eqNullSafe(F.col("__lang"))).drop("__l2"), "quality-fences"
    )
    outlying = [
        (F.expr(rate) > F.greatest(f"__s_{name}", f"__l_{name}")) for name, (rate, _) in RATES.items()
    ]
    verdict = F.coalesce(~F.greatest(*outlying), F.lit(True)) & ~F.col("base_failed")
    return (
        judged.join(
            known,
            F.col(lang).eqNullSafe(F.col("__lang")) & F.col(source).eqNullSafe(F.col("__source")),
            "left",
        )
        .withColumn("kept", verdict)
        .select(*rows.columns, "base_failed", "kept")
    )


def quality_rules(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang, source, measures, base_failed, kept.

    Null and empty texts have no words and fail the base rules. Texts are
    measured whole, and all of them enter the sketches. Repeated rows give
    repeated results; an empty table gives none.
    """
    keep = [F.col(id_column).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source")]
    rows = stored(measured(docs, F.col(text), keep), "quality-measures")
    return rules(rows, "lang", "source")
