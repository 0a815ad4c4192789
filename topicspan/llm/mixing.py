"""Mixing sources to target weights.

Rows get hash-random keys, are range-sorted within their source, and a running
sum of sizes, distributed over the tasks, tells where each source's budget
ends. Whole epochs come first; the rest is cut at the exact word.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspan.llm.common import SPACES, running_sums, stored, word_count

# Defaults of the mix: weights of the sources in turn, the share of all words
# to hand out, and the most often that a source may be repeated.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS
) -> DataFrame:
    """(source, source_size, start, target): the words that each source is to give.

    ``sizes`` has (source, size). Sources are taken by code point, null last,
    and weigh ``weights`` in turn. A target is at most ``most`` times the size
    of its source; what is over goes to the others by weight. So a target is
    ``min(most * size, level * weight)``, and the level follows from running
    sums over the sources by the ratio at which they are full.

    Sources without words get 0; no rows, no targets. ``start`` is the sum of
    the sizes of all sources that come earlier.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    named = running_sums(
        totals, [F.col("source").asc_nulls_last()], ["source_size", "one"], "mix-sources"
    )
    turn = F.array(*[F.lit(int(w)) for w in weights])
    full = named.select(
        "source",
        "source_size",
        F.col("before_source_size").alias("start"),
        F.element_at(turn, (F.col("before_one") % len(weights) + 1).cast("int")).cast("long").alias("weight"),
        (F.col("source_size") * most).alias("ceiling"),
    ).withColumn("ratio", F.col("ceiling") / F.col("weight"))
    filled = running_sums(
        full, [F.col("ratio"), F.col("source").asc_nulls_last()], ["ceiling", "weight"], "mix-level"
    )
    whole = filled.agg(
        (F.sum("source_size") * F.lit(float(share))).alias("handed"), F.sum("weight").alias("weights")
    )
    level = (
        filled.join(F.broadcast(whole))  # one row
        .withColumn(
            "level",
            (F.col("handed") - F.col("before_ceiling")) / (F.col("weights") - F.col("before_weight")),
        )
        .where(F.col("level") <= F.col("ratio"))
        .agg(F.min_by("level", F.struct("ratio", "before_weight")).alias("level"))
    )
    target = F.least(F.col("ceiling").cast("double"), F.col("level") * F.col("weight"))
    return (
        filled.join(F.broadcast(level))  # one row
        .select("source", "source_size", "start", F.coalesce(target, F.col("ceiling")).alias("target"))
    )


def mix(
    rows: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST_EPOCHS,
    seed: int = 42,
) -> DataFrame:
    """How many words the mix takes of each row: adds source_size, target, taken.

    ``rows`` has (id, source, size, ...); further columns are kept. Each source
    gives ``round(target)`` words: as many whole epochs as fit, then its rows in
    the order of a key that hashes seed and id, the last of them in part. The
    order among equal keys is by id and size, so that reruns agree.

    Null ids hash as the empty text, null sizes count as 0, a null source is a
    source of its own. Rows without words are kept with taken 0.
    """
    sized = rows.withColumn("size", F.coalesce("size", F.lit(0)).cast("long"))
    targets = source_targets(sized.select("source", "size"), weights, share, most)
    keyed = sized.withColumn(
        "__key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    )
    order = [F.col("source").asc_nulls_last(), F.col("__key"), F.col("id"), F.col("size")]
    placed = running_sums(keyed, order, ["size"], "mix-rows").drop("__key")
    per_source = targets.select(
        F.col("source").alias("__source"), "source_size", "target", "start"
    )
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.floor(F.when(F.col("source_size") > 0, budget / F.col("source_size")).otherwise(0))
    rest = budget - epochs * F.col("source_size") - (F.col("before_size") - F.col("start"))
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))
    return (
        placed.join(stored(per_source, "mix-targets"), F.col("source").eqNullSafe(F.col("__source")))
        .withColumn("taken", taken.cast("long"))
        .drop("__source", "start", "before_size")
    )


def mixed_documents(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", **settings
) -> DataFrame:
    """The mix itself: rows of ``docs``, with their columns, as often as taken.

    A row that is taken in part is cut after the last of its words; a column
    ``n_chars``, where there is one, then holds the new length. Rows without
    words hold nothing to mix and are left out.
    """
    rows = docs.select(
        F.col(id_column).alias("id"),
        F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    )
    taken = mix(rows, **settings).where(F.col("taken") > 0)
    copies = taken.select(
        "row",
        F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)).alias("epoch"),
        "taken",
        "size",
    ).withColumn("words", F.least("size", F.col("taken") - F.col("epoch") * F.col("size")))
    head = F.array_join(
        F.slice(
            F.regexp_extract_all(F.col(f"row.{text}"), F.lit(f"[{SPACES}]*[^{SPACES}]+"), F.lit(0)),
            F.lit(1),
            F.col("words").cast("int"),
        ),
        "",
    )
    cut = copies.withColumn(
        "text", F.when(F.col("words") < F.col("size"), head).otherwise(F.col(f"row.{text}"))
    )
    kept = {c: F.col(f"row.`{c}`") for c in docs.columns}
    kept[text] = F.col("text")
    if "n_chars" in kept:
        kept["n_chars"] = F.when(
            F.col("words") < F.col("size"), F.length("text").cast(docs.schema["n_chars"].dataType)
        ).otherwise(kept["n_chars"])
    return cut.select(*[value.alias(name) for name, value in kept.items()])
