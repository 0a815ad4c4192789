"""Sequential ids without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from topicspan.session import checkpointed, sized

_POSITION_BITS = 33  # monotonically_increasing_id: partition above, row position below


def with_row_ids(
    df: DataFrame, name: str, order_by: Sequence[str] = (), start: int | Column = 1
) -> DataFrame:
    """Add ids ``start``, ``start + 1``, ... in the order of ``order_by``.

    Every partition numbers its own rows; partition offsets come from one
    count per partition. The rows are written to the shared folder first, so
    that both passes, and any task that is run again, see the same partitions.

    Rows with equal keys are ordered by a hash of the row, and copies of a row
    at random: otherwise a frequent key would be sorted in a single task.
    """
    ties = (F.xxhash64(*df.columns), F.rand(seed=42))
    rows = df.orderBy(*order_by, *ties) if order_by else df
    fixed = checkpointed(rows)
    placed = fixed.withColumn("__part", F.spark_partition_id()).withColumn(
        "__pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    )
    # One row per partition: the window sees as many rows as there are tasks.
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sized(
        sizes.select("__part", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__offset"))
    )
    first = F.lit(start) if isinstance(start, int) else start
    return (
        placed.join(offsets, "__part")
        .withColumn(name, (F.col("__offset") + F.col("__pos") + first).cast(LongType()))
        .drop("__part", "__pos", "__offset")
    )


def largest_id(df: DataFrame, column: str = "docid") -> int:
    """Largest numeric id; ids that are not numbers do not count."""
    found = df.agg(F.max(F.col(column).try_cast("bigint")).alias("m")).first()["m"]
    return int(found or 0)
