"""Reading corpora and label tables, writing results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from topicspan.operators.ids import with_row_ids

LABEL_SCHEMA = StructType([StructField("topic", IntegerType()), StructField("label", StringType())])


def read_corpus_csv(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """CSV with a header, every column a string; ``columns`` are chosen by name.

    Files are split, so a text is one line. ``multi_line=True`` reads quoted
    texts with line breaks, at one task per file. An empty field is null, a
    quoted empty one an empty text.
    """
    reader = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", "\0")  # what an empty field turns into before it is null
    )
    rows = reader.csv(path)
    return rows.select(*[F.col(f"`{c}`") for c in columns]) if columns else rows


def column_names(df: DataFrame) -> list[str]:
    """Columns to choose the text, label and id roles from."""
    return list(df.columns)


def define_corpus(
    df: DataFrame,
    text_column: str,
    label_column: str | None = None,
    id_column: str | None = None,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """The fixed corpus relation (docid, text, appTag), all strings.

    Without ``id_column`` ids 1..N are made, in the order of ``order_by`` or,
    if none is given, in the order in which the source is read.
    """
    wanted = [c for c in (text_column, label_column, id_column, *order_by) if c]
    missing = sorted(set(wanted) - set(df.columns))
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}; have {', '.join(df.columns)}")
    if id_column is None:
        df = with_row_ids(df.select(*dict.fromkeys(wanted)), "__docid", order_by)
        id_column = "__docid"
    label = F.col(label_column).cast("string") if label_column else F.lit(None).cast("string")
    return df.select(
        F.col(id_column).cast("string").alias("docid"),
        F.col(text_column).cast("string").alias("text"),
        label.alias("appTag"),
    )


def default_labels(spark: SparkSession, topics: int, label: str = "unknown") -> DataFrame:
    """Label table for topics 1..k before anyone has named them."""
    return spark.range(1, topics + 1).select(
        F.col("id").cast("int").alias("topic"), F.lit(label).alias("label")
    )


def numbered_labels(spark: SparkSession, topics: int, prefix: str = "topic") -> DataFrame:
    """Label table ``topic1`` .. ``topick``."""
    return spark.range(1, topics + 1).select(
        F.col("id").cast("int").alias("topic"),
        F.concat(F.lit(prefix), F.col("id").cast("string")).alias("label"),
    )


def read_labels_csv(spark: SparkSession, path: str, topics: int) -> DataFrame:
    """Saved label table; it must have one row for each of the k topics.

    A table with another number of rows belongs to another model.
    """
    raw = read_corpus_csv(spark, path, multi_line=True)  # one row per topic
    labels = raw.select(F.col("topic").cast("int").alias("topic"), "label", *[
        c for c in raw.columns if c not in ("topic", "label")
    ])
    found = labels.count()
    if found != topics:
        raise ValueError(f"label table has {found} rows, the model has {topics} topics")
    return labels


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with header, one file per task; an empty text is quoted, null is not."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("emptyValue", '""')
        .csv(path)
    )


def write_clusters(clustered: DataFrame, folder: str, topics: int, fmt: str = "parquet") -> str:
    """Export a clustered corpus under a name that tells its topic count.

    Parquet is partitioned by topic, so that a reader of one topic skips the
    rest. The rebalance hint gathers a topic into few files, and lets AQE split
    a large topic over many tasks.
    """
    path = f"{folder.rstrip('/')}/clustered_{topics}_topics"
    if fmt == "csv":
        write_csv(clustered, path)
    elif fmt == "parquet":
        clustered.hint("rebalance", F.col("topic")).write.partitionBy("topic").parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return path
