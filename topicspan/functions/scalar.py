"""Small numeric and string expressions shared by the operators."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_max_position(values: Column) -> Column:
    """1-based position of the largest entry; the first one wins a tie.

    Null when nothing is positive: a text without a known word has an
    all-zero score vector and belongs to no topic.
    """
    best = F.array_max(values)
    return F.when(best > 0, F.array_position(values, best).cast("int"))


def softmax(scores: Column) -> Column:
    """Probabilities from log scores, shifted by the maximum first."""
    shifted = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    total = F.aggregate(shifted, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(shifted, lambda x: x / total)


def log2_ratio(other: Column, start: Column) -> Column:
    """log2(other / start): positive where the term is stronger elsewhere."""
    return F.log2(F.try_divide(other, start))


def page_of(topic: Column, size: int = 10) -> Column:
    """Caption of the page a topic is shown on: ``1..10``, ``11..20``, ..."""
    first = (F.floor((topic - 1) / size) * size + 1).cast("int")
    return F.concat_ws("..", first.cast("string"), (first + F.lit(size - 1)).cast("string"))


def parse_page(caption: str) -> tuple[int, int]:
    """Bounds of a page caption such as ``11..20``."""
    found = re.fullmatch(r"\s*(\d+)\.\.(\d+)\s*", caption)
    if not found:
        raise ValueError(f"not a topic range: {caption!r}")
    return int(found[1]), int(found[2])


def strip_prefix(value: Column, prefix: str) -> Column:
    """Remove ``prefix`` once from the start of a string."""
    return F.regexp_replace(value, "^" + re.escape(prefix), "")


def topic_caption(topic: Column, label: Column) -> Column:
    """Topic number and label as one display string."""
    return F.concat_ws(" ", topic.cast("string"), label)
