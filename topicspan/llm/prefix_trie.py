"""Conversation prefix trie by ROLLUP over positional turn columns.

A conversation is a path of turns (role, text); the trie has one node per
distinct prefix. Turns are replaced by 128-bit keys and laid out in columns
t1..tW; ``ROLLUP(prev, t1, ..., tW)`` then makes one group per prefix, and
``grouping_id`` tells its depth. Long conversations go on in further column
blocks of doubling width, keyed by ``prev``: the node (its smallest member)
where the previous block ended. Every node is named by its smallest member
and depth, which no other node shares.

Aggregates over a subtree use owners: each node is owned by its smallest
member. The nodes below a node N are exactly the owned nodes, at N's depth
or deeper, of N's members; so a second ROLLUP adds up, per member, the
owned leaves and saved tokens from each depth on. Nothing is gathered per
node but the ids of conversations that end there (8 bytes each), which
ends_sha256 needs in order.

Defined results:

* rows with a null conv_id belong to no conversation and are left out;
* turns are ordered by turn (null first), then role and text, so ties are
  ordered; repeated rows are repeated turns; null role or text is empty;
* a conversation without turns is a member of the root alone;
* keys are MD5 of the role's length, role and text, so two turns are one
  only if equal (a collision has odds near 2^-128);
* an empty table gives no node, not even a root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicspan.llm.common import stored

# Fixed values of the contract.
FAMILY = 100
KEEP_OF = 6
# Width of the first column block; each later one is twice as wide, up to
# MAX_WIDTH: a ROLLUP of W columns repeats each row W + 2 times, and its plan
# (and the driver's memory for it) grows with W squared.
FIRST_WIDTH = 8
MAX_WIDTH = 60


def block_starts(longest: int, first: int = FIRST_WIDTH) -> list[tuple[int, int]]:
    """(start depth, width) of every block needed for ``longest`` turns."""
    blocks, start, width = [(0, first)], first, min(first * 2, MAX_WIDTH)
    while start < longest:
        blocks.append((start, width))
        start, width = start + width, min(width * 2, MAX_WIDTH)
    return blocks


def rebuilt_paths(convs: DataFrame) -> DataFrame:
    """(conv_id, n_turns, keys, lens): each conversation rebuilt from its family's
    first one and its own turns, as turn keys and text lengths."""
    rows = convs.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").isNotNull().alias("has"),
            F.col("turn").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    own = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % KEEP_OF).cast("int")
    first = own.select(F.col("conv_id").alias("__base"), F.col("own").alias("__first"))
    joined = own.withColumn("__base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(first, "__base", "left")
    joined = joined.withColumn("__h", h)
    turns = F.concat(
        F.filter(F.coalesce("__first", F.array().cast(first.schema["__first"].dataType)), lambda _, i: i < F.col("__h")),
        F.filter("own", lambda _, i: i >= F.col("__h")),
    )
    key = lambda t: F.unhex(F.md5(F.concat(F.length(t.role).cast("string"), F.lit(":"), t.role, t.text)))
    return joined.select(
        "conv_id",
        F.size(turns).alias("n_turns"),
        F.transform(turns, key).alias("keys"),
        F.transform(turns, lambda t: F.length(t.text).cast("long")).alias("lens"),
    )


def path_key(block: int, prev: Column, parts: list[Column]) -> Column:
    """Key of a prefix: its block, the node it starts from and its turn keys."""
    head = F.concat(F.lit(f"{block}:"), prev.cast("string"), F.lit(":")).cast("binary")
    return F.unhex(F.md5(F.concat(head, *parts)))


def key_at(block: int, start: int, depth: Column) -> Column:
    """Per conversation row: key of its own prefix of ``depth`` turns in the block."""
    parts = F.slice("keys", start + 1, depth - start)
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda acc, k: F.concat(acc, k))
    return path_key(block, F.col("prev"), [joined])


def block_rows(paths: DataFrame, prev: DataFrame | None, block: int, start: int) -> DataFrame:
    """Conversations that reach the block, with the node they enter it from."""
    if prev is None:
        return paths.withColumn("prev", F.lit(0).cast("long"))
    return paths.where(F.col("n_turns") >= start).join(prev, "conv_id")


def rollup_nodes(rows: DataFrame, block: int, start: int, width: int, sums: list[str]) -> DataFrame:
    """One row per node of the block: level, depth, key, parent key, and aggregates."""
    t = [F.when(F.col("n_turns") >= start + j, F.element_at("keys", start + j)).alias(f"t{j}") for j in range(1, width + 1)]
    ln = [F.when(F.col("n_turns") >= start + j, F.element_at("lens", start + j)).alias(f"l{j}") for j in range(1, width + 1)]
    extra = [F.col(s) for s in sums]
    laid = rows.select("conv_id", "prev", *t, *ln, *extra)
    aggs = [
        F.count("*").alias("n_convs"),
        F.min("conv_id").alias("conv_id"),
        *[F.max(f"l{j}").alias(f"l{j}") for j in range(1, width + 1)],
        *[F.sum(s).alias(s) for s in sums],
        F.grouping_id().alias("gid"),
    ]
    groups = laid.rollup("prev", *[f"t{j}" for j in range(1, width + 1)]).agg(*aggs)
    level = F.lit(width) - F.bit_count("gid")
    groups = groups.where(F.col("gid") < 2**width).withColumn("level", level.cast("int"))
    real = F.element_at(F.array(*[F.col(f"t{j}") for j in range(1, width + 1)]), F.greatest(F.col("level"), F.lit(1)))
    keep = (F.col("level") >= 1) & real.isNotNull()
    if block == 0:
        keep = keep | (F.col("level") == 0)
    groups = groups.where(keep)
    parts = [F.coalesce(F.col(f"t{j}"), F.lit(b"").cast("binary")) for j in range(1, width + 1)]
    up = [F.when(F.col("level") > j, F.col(f"t{j}")).otherwise(F.lit(b"").cast("binary")) for j in range(1, width + 1)]
    last_len = F.element_at(F.array(F.lit(0).cast("long"), *[F.col(f"l{j}") for j in range(1, width + 1)]), F.col("level") + 1)
    return groups.select(
        F.lit(block).alias("block"),
        "level",
        (F.col("level") + start).cast("long").alias("depth"),
        "prev",
        "conv_id",
        F.col("n_convs").cast("long").alias("n_convs"),
        F.coalesce(last_len, F.lit(0)).cast("long").alias("last_len"),
        path_key(block, F.col("prev"), parts).alias("key"),
        path_key(block, F.col("prev"), up).alias("parent_key"),
        *sums,
    )


def prefix_trie(convs: DataFrame, first_width: int = FIRST_WIDTH) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    paths = stored(rebuilt_paths(convs), "trie-paths")
    longest = paths.agg(F.max("n_turns")).first()[0]
    if longest is None:
        empty = paths.select(
            F.col("conv_id"), *[F.lit(None).cast("long").alias(c) for c in ("depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")],
            F.lit("").alias("ends_sha256"),
        )
        return empty.limit(0)
    blocks = block_starts(longest, first_width)

    # Pass 1: nodes, the entry node of every block, and where each conversation ends.
    nodes, ends, entries = [], [], []
    prev = None
    for b, (start, width) in enumerate(blocks):
        rows = block_rows(paths, prev, b, start)
        entries.append(prev)
        found = stored(rollup_nodes(rows, b, start, width, []), "trie-nodes")
        nodes.append(found)
        stop = (F.col("n_turns") > start) & (F.col("n_turns") <= start + width)
        if b == 0:
            stop = stop | (F.col("n_turns") == 0)
        ending = rows.where(stop).select("conv_id", key_at(b, start, F.col("n_turns")).alias("key"))
        ends.append(ending)
        if start + width < longest:
            onward = rows.where(F.col("n_turns") > start + width).select(
                "conv_id", key_at(b, start, F.lit(start + width)).alias("key")
            )
            prev = stored(
                onward.join(found.where(F.col("level") == width).select("key", F.col("conv_id").alias("prev")), "key")
                .select("conv_id", "prev"),
                "trie-entry",
            )
    all_nodes = _union(nodes)
    ended = (
        _union(ends)
        .groupBy("key")
        .agg(F.sha2(F.array_join(F.sort_array(F.collect_list("conv_id")), ","), 256).alias("ends_sha256"))
    )
    parents = all_nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    linked = all_nodes.join(parents, "parent_key", "left").withColumn(
        "parent_conv_id",
        F.when(F.col("depth") == 0, F.lit(None).cast("long"))
        .when((F.col("block") > 0) & (F.col("level") == 1), F.col("prev"))
        .otherwise(F.col("parent_conv_id")),
    )
    children = linked.where(F.col("parent_conv_id").isNotNull()).groupBy(
        F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")
    ).agg(F.count("*").alias("n_children"))
    linked = stored(
        linked.join(children, ["conv_id", "depth"], "left").join(ended, "key", "left").select(
            "block", "level", "depth", "conv_id", "parent_conv_id", "n_convs", "key",
            F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            ((F.col("n_convs") - 1) * F.col("last_len")).alias("saved"),
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        ),
        "trie-linked",
    )

    # Pass 2: subtree sums, each node counted once through its owner.
    owned = linked.groupBy("conv_id").agg(
        F.collect_list(F.struct("depth", (F.col("n_children") == 0).cast("long").alias("leaf"), "saved")).alias("owned")
    )
    owned_of = F.coalesce("owned", F.array().cast(owned.schema["owned"].dataType))
    depths = F.sequence(F.lit(0), F.col("n_turns"))
    suffix = lambda field: F.transform(
        depths,
        lambda d: F.aggregate(
            F.filter(owned_of, lambda o: o.depth >= d), F.lit(0).cast("long"), lambda a, o: a + o[field]
        ),
    )
    # Per conversation, from each depth on: owned leaves and saved tokens.
    with_owned = stored(
        paths.join(owned, "conv_id", "left").select(
            "conv_id", "n_turns", "keys", "lens", suffix("leaf").alias("leaf_from"), suffix("saved").alias("saved_from")
        ),
        "trie-owned",
    )
    totals = []
    for b, (start, width) in enumerate(blocks):
        rows = block_rows(with_owned, entries[b], b, start)
        zero = F.lit(0).cast("long")
        at = lambda j: F.lit(start + j + 1)
        picked = [
            F.coalesce(F.try_element_at(column, at(j)), zero).alias(f"{name}{j}")
            for j in range(width + 1)
            for name, column in (("sl", "leaf_from"), ("ss", "saved_from"))
        ]
        rows = rows.select("*", *picked)
        sums = [f"{name}{j}" for j in range(width + 1) for name in ("sl", "ss")]
        summed = rollup_nodes(rows, b, start, width, sums)
        pick = lambda p: F.element_at(F.array(*[F.col(f"{p}{j}") for j in range(width + 1)]), F.col("level") + 1)
        totals.append(
            stored(summed.select("key", pick("sl").alias("n_leaves"), pick("ss").alias("saved_tokens")), "trie-sums")
        )
    result = linked.join(_union(totals), "key")
    return result.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.col("n_leaves").cast("long").alias("n_leaves"),
        F.col("saved_tokens").cast("long").alias("saved_tokens"),
        "ends_sha256",
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
