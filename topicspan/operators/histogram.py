"""Equal-width histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, lower, upper, n) over ``bins`` equal, right-closed intervals.

    The smallest value belongs to the first bin. Bins without rows are listed
    with 0. One pass for the range, one for the counts.
    """
    value = F.col(column).cast("double")
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None:
        low, high = 0.0, 0.0
    width = (high - low) / bins or 1.0
    place = F.ceil((value - F.lit(low)) / F.lit(width))
    counted = (
        df.where(value.isNotNull())
        .groupBy(F.least(F.greatest(place, F.lit(1)), F.lit(bins)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    edges = df.sparkSession.range(1, bins + 1).select(
        F.col("id").cast("int").alias("bin"),
        (F.lit(low) + (F.col("id") - 1) * F.lit(width)).alias("lower"),
        (F.lit(low) + F.col("id") * F.lit(width)).alias("upper"),
    )
    return edges.join(counted, "bin", "left").na.fill(0, ["n"])
