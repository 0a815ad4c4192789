"""Joining per-key values back to rows when some keys are very frequent.

AQE splits a skewed join only if both sides come straight from a shuffle. A
table that was just aggregated by the join key does not, so the frequent keys
are taken out here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is frequent if it has more than 1/1000 of the rows, or than a quarter of
# what a task of the shuffle gets on average, whichever is less.
HOT_PARTS = 1000


# Where rows can be read twice, keys with more than 1/200,000 of them do not enter
# a shuffle: fewer than 200,000 keys, whatever the data, and most rows of a text.
COMMON_PARTS = 200_000


def frequent_keys(weights: DataFrame, weight: str, parts: int = HOT_PARTS) -> DataFrame:
    """The rows of ``weights`` (one per key) that alone would weigh on a task.

    There are fewer than ``parts`` of them, or than four for each task of a shuffle,
    whatever the data.
    """
    tasks = int(weights.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = weights.agg(F.sum(weight)).scalar()
    return weights.where(F.col(weight) * max(parts, 4 * tasks) > total)


def look_up(
    rows: DataFrame,
    table: DataFrame,
    hot: DataFrame,
    key: str,
    columns: Sequence[str],
    spread_by: str,
) -> DataFrame:
    """Add ``columns`` of ``table``, which has one row per ``key``.

    ``hot`` holds the table rows of frequent keys; being few they
    are broadcast. Rows that found their values there go through the shuffle
    under a key made from ``spread_by``, and so to all tasks evenly. Should
    such a key exist in the table, the values already found still win.
    """
    found = F.struct(*columns)
    first = F.broadcast(hot.select(key, found.alias("__hot")))
    rest = table.select(F.col(key).alias("__key"), found.alias("__cold"))
    spread = F.concat(F.lit("\u0000"), F.hash(spread_by).cast("string"))
    return (
        rows.join(first, key, "left")
        .withColumn("__key", F.when(F.col("__hot").isNull(), F.col(key)).otherwise(spread))
        .join(rest, "__key", "left")
        .withColumn("__found", F.coalesce("__hot", "__cold"))
        .select(*rows.columns, *[F.col(f"__found.{c}").alias(c) for c in columns])
    )


def look_up_apart(
    rows: DataFrame, table: DataFrame, common: DataFrame, key: str, columns: Sequence[str]
) -> DataFrame:
    """:func:`look_up` for stored ``rows``, which are read twice here.

    ``common`` holds the table rows of keys that most rows have. Rows that find
    theirs there stay where they are; only the others are shuffled.
    """
    few = common.select(key, *columns)
    found = rows.join(F.broadcast(few), key)
    rest = rows.join(F.broadcast(few.select(key)), key, "left_anti")
    both = found.unionByName(rest.join(table.select(key, *columns), key, "left"))
    return both.select(*rows.columns, *columns)
