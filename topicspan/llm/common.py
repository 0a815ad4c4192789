"""What the operators on training data share: words, stored tables, running sums.

Every operator picks the columns it needs under names of its own, so further
columns of the input, whatever they are called, never clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from topicspan.session import stored  # noqa: F401 - the operators take it from here

# The characters that separate words are space and \t \n \v \f \r.
SPACES = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACES}]+"
# Rows of a batch that goes to Python: texts are long, so batches are short.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Send texts to Python in batches whose size stays small for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_columns_of(
    df: DataFrame,
    keep: Sequence[str],
    fields: Sequence[StructField],
    maker: Callable[[], Callable[[pa.RecordBatch], Sequence]],
) -> DataFrame:
    """Columns ``keep`` of ``df`` and new ``fields``, computed batch by batch.

    ``maker`` is called once per task; what it returns turns a batch into one
    array or list per new field. Kept columns pass through as they are.
    """
    schema = StructType([*[df.schema[c] for c in keep], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = maker()
        for batch in batches:
            new = [
                pa.array(values, type=to_arrow_type(field.dataType))
                for values, field in zip(compute(batch), fields, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *new], schema.names)

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch; null is empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def running_sums(df: DataFrame, order: Sequence[Column], values: Sequence[str], name: str) -> DataFrame:
    """Add ``before_<v>``: the sum of ``v`` over all rows that come earlier.

    Rows are range-partitioned and sorted by ``order``. Each task adds up its
    own rows; one row per task then carries the sums from task to task.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    places = [StructField("__part", LongType()), *[StructField(f"__in_{v}", LongType()) for v in values]]

    def within() -> Callable[[pa.RecordBatch], list]:
        part, so_far = TaskContext.get().partitionId(), dict.fromkeys(values, 0)

        def place(batch: pa.RecordBatch) -> list:
            out = [np.full(batch.num_rows, part, dtype=np.int64)]
            for v in values:
                own = batch.column(v).to_numpy(zero_copy_only=False).astype(np.int64)
                upto = np.cumsum(own) + so_far[v]
                out.append(upto - own)
                so_far[v] = int(upto[-1]) if len(upto) else so_far[v]
            return out

        return place

    placed = stored(with_columns_of(rows, df.columns, places, within), name)
    sums = placed.groupBy("__part").agg(*[F.sum(v).alias(f"__sum_{v}") for v in values])
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "__part", *[F.coalesce(F.sum(f"__sum_{v}").over(earlier), F.lit(0)).alias(f"__off_{v}") for v in values]
    )
    return placed.join(offsets, "__part").select(
        *df.columns, *[(F.col(f"__off_{v}") + F.col(f"__in_{v}")).alias(f"before_{v}") for v in values]
    )
