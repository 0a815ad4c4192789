"""MinHash near-duplicates by an LSH forest.

Equal shingle sets are one node from the start. Every tree of the forest sorts
the nodes by its own part of the signature; nodes that share a prefix of
``DEPTH`` values make a region of that tree. Inside a region neighbours in
sorted order share the longest prefixes, so the depth adapts to how dense the
region is. Links are confirmed on full sets. What neighbours have not joined is
then compared region by region: all pairs of different components there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField

from topicspan.llm.common import stored, texts_of, with_columns_of
from topicspan.llm.components import components

SHINGLE = 5
SIMILAR = 75  # percent of the union that two sets share
TREES = 32
DEPTH = 4  # a pair at 75 % shares no region with probability (1 - 0.75**4)**32 = 5e-6
SIZE = TREES * DEPTH
# Share of equal signature values below which a pair is not looked at in full:
# six standard errors below 0.75.
LEAST_ALIKE = 0.5
BLOCK = 256

_rng = np.random.default_rng(20240601)
_TABLE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _rng.integers(0, 1 << 63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _rng.integers(0, 1 << 63, SIZE, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(2 * n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles of ``text``.

    A-Z are lower-cased. Fewer words make one shingle, no words none.
    """
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    data = np.frombuffer(b" ".join(words), dtype=np.uint8)
    power, inverse = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[data] * power[:-1], out=sums[1:])
    ends = np.append(np.flatnonzero(data == 32), len(data))
    starts = np.append(0, ends[:-1] + 1)
    wide = max(1, len(words) - SHINGLE + 1)
    begin, end = starts[:wide], ends[-wide:]
    h = (sums[end] - sums[begin]) * inverse[begin]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.unique(h ^ (h >> np.uint64(31)))


def signature(hashes: np.ndarray) -> bytes:
    """``SIZE`` MinHash values of 16 bits."""
    lowest = np.full(SIZE, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 1024):
        some = hashes[None, at : at + 1024] * _FACTORS[:, None] + _TERMS[:, None]
        np.minimum(lowest, some.min(axis=1), out=lowest)
    # The lowest values are near 0: hash them again, so that all 16 bits count.
    return ((lowest * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)).astype(">u2").tobytes()


def signatures(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(doc_id, n_shingles, node, sig); node names the set, null for an empty one."""
    chosen = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text}`").alias("__text"))

    def maker():
        def sign(batch: pa.RecordBatch) -> list:
            counts, nodes, sigs = [], [], []
            for t in texts_of(batch, "__text"):
                hashes = shingle_set(t)
                counts.append(len(hashes))
                nodes.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None)
                sigs.append(signature(hashes) if len(hashes) else None)
            return [counts, nodes, sigs]

        return sign

    fields = [
        StructField("n_shingles", LongType()),
        StructField("node", BinaryType()),
        StructField("sig", BinaryType()),
    ]
    return with_columns_of(chosen, ["doc_id"], fields, maker)


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def _sizes_fit(n: Column, m: Column) -> Column:
    return 100 * F.least(n, m) >= SIMILAR * F.greatest(n, m)


def tree_rows(nodes: DataFrame) -> DataFrame:
    """(region, node): the region of every node in every tree, where it has company."""
    at = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    rows = nodes.select("node", "sig", at).select(
        "node", F.xxhash64("tree", F.substring("sig", F.col("tree") * (2 * DEPTH) + 1, F.lit(2 * DEPTH))).alias("region"), "tree"
    )
    shared = stored(rows.groupBy("region").count().where("count > 1"), "regions")
    return stored(rows.join(shared, "region").select("region", "tree", "node", "count"), "members")


def neighbours(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, alike): nodes next to each other in the sorted order of a tree's region.

    Rows are range-sorted by region and by the signature from the tree's place
    on. A region may span tasks; the one pair at each border is left to
    ``across``.
    """
    start = F.col("tree") * (2 * DEPTH)
    rows = members.join(nodes.select("node", "sig", "n_shingles"), "node").select(
        "region",
        F.concat(
            F.substring("sig", start + 1, F.lit(2 * SIZE)), F.substring("sig", F.lit(1), start)
        ).alias("order"),
        "node",
        "sig",
        "n_shingles",
    )
    keys = ["region", "order", "node"]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def pair(batches):
        last = None
        for b in batches:
            if last is not None:
                b = pd.concat([last, b], ignore_index=True)
            last = b.tail(1)
            if len(b) < 2:
                continue
            sig = np.frombuffer(b"".join(b["sig"]), dtype=np.uint16).reshape(len(b), SIZE)
            n = b["n_shingles"].to_numpy()
            region = b["region"].to_numpy()
            alike = _alike(sig[:-1], sig[1:])
            fit = 100 * np.minimum(n[:-1], n[1:]) >= SIMILAR * np.maximum(n[:-1], n[1:])
            at = np.flatnonzero((region[:-1] == region[1:]) & (alike >= LEAST_ALIKE) & fit)
            names = b["node"].to_numpy()
            one, two = names[at], names[at + 1]
            yield pd.DataFrame(
                {
                    "a": [min(x, y) for x, y in zip(one, two, strict=True)],
                    "b": [max(x, y) for x, y in zip(one, two, strict=True)],
                    "alike": alike[at],
                }
            )

    pairs = ordered.select("region", "node", "sig", "n_shingles").mapInPandas(
        pair, "a binary, b binary, alike double"
    )
    return pairs.groupBy("a", "b").agg(F.max("alike").alias("alike"))


def across(members: DataFrame, nodes: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): links between different components of a region, as many as join them.

    Nodes outside the region's largest component meet all nodes of the region,
    in blocks of both. Full sets travel with the blocks, so that only links leave
    a task, never pairs that were merely compared.
    """
    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = stored(rooted, "rooted")
    sizes = rooted.groupBy("region", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = stored(
        sizes.groupBy("region")
        .agg(
            F.max_by("root", F.struct("n", "root")).alias("main"),
            F.sum("n").alias("n_all"),
            (F.sum("n") - F.max("n")).alias("n_out"),
        )
        .where("n_out > 0"),
        "mixed",
    )
    sized = (
        rooted.join(mixed, "region")
        .withColumn("out", F.col("root") != F.col("main"))
        .join(nodes.select("node", "sig", "n_shingles"), "node")
        .join(sets, "node")
    )
    lots = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), lots("n_out")).cast("int")
    own_all = F.pmod(F.xxhash64("node"), lots("n_all")).cast("int")
    columns = ["region", "node", "root", "sig", "n_shingles", "hashes"]
    left = sized.where("out").select(
        *columns, own.alias("i"), F.explode(F.sequence(F.lit(0), lots("n_all") - 1)).alias("j"), F.lit(True).alias("left")
    )
    right = sized.select(
        *columns, F.explode(F.sequence(F.lit(0), lots("n_out") - 1)).alias("i"), own_all.alias("j"), F.lit(False).alias("left")
    )

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        one, two = group[group["left"]], group[~group["left"]]
        found = []
        if len(one) and len(two):
            sig = np.frombuffer(b"".join(two["sig"]), dtype=np.uint16).reshape(len(two), SIZE)
            n, names, hashes = two["n_shingles"].to_numpy(), two["node"].to_numpy(), two["hashes"].to_numpy()
            numbers = {r: i for i, r in enumerate(group["root"].unique())}
            joined = np.arange(len(numbers))  # components of this block that links have joined
            root = two["root"].map(numbers).to_numpy()
            for r in one.itertuples():
                fit = 100 * np.minimum(n, r.n_shingles) >= SIMILAR * np.maximum(n, r.n_shingles)
                near = _alike(sig, np.frombuffer(r.sig, dtype=np.uint16)) >= LEAST_ALIKE
                own = numbers[r.root]
                for k in np.flatnonzero(fit & near):
                    if joined[own] == joined[root[k]]:
                        continue
                    both = len(np.intersect1d(r.hashes, hashes[k], assume_unique=True))
                    if 100 * both >= SIMILAR * (len(r.hashes) + len(hashes[k]) - both):
                        found.append((min(r.node, names[k]), max(r.node, names[k])))
                        joined[joined == joined[root[k]]] = joined[own]
        return pd.DataFrame(found, columns=["a", "b"])

    blocks = left.unionByName(right)
    return blocks.groupBy("region", "i", "j").applyInPandas(meet, "a binary, b binary").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets share 75 % of their union."""
    one = sets.select(F.col("node").alias("a"), F.col("hashes").alias("__one"))
    two = sets.select(F.col("node").alias("b"), F.col("hashes").alias("__two"))
    both = F.size(F.array_intersect("__one", "__two"))
    union = F.size("__one") + F.size("__two") - both
    return pairs.select("a", "b").join(one, "a").join(two, "b").where(100 * both >= SIMILAR * union).select("a", "b")


def sets_of(docs: DataFrame, id_column: str, text: str, wanted: DataFrame) -> DataFrame:
    """(node, hashes) of the nodes in ``wanted`` (node, doc_id, n_shingles), from their texts."""
    chosen = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text}`").alias("__text"))
    texts = chosen.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")

    def maker():
        def read(batch: pa.RecordBatch) -> list:
            sets = [shingle_set(t) for t in texts_of(batch, "__text")]
            return [
                [hashlib.blake2b(h.tobytes(), digest_size=16).digest() for h in sets],
                [h.view(np.int64) for h in sets],
            ]

        return read

    fields = [StructField("node", BinaryType()), StructField("hashes", ArrayType(LongType()))]
    return with_columns_of(texts, ["doc_id"], fields, maker).join(
        wanted.select("doc_id", "node"), ["doc_id", "node"], "left_semi"
    ).dropDuplicates(["node"]).select("node", "hashes")


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """Roots after further links between nodes."""
    if roots is None:
        return components(links)
    old_a = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    old_b = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    over = links.join(old_a, "a", "left").join(old_b, "b", "left").select(
        F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")
    )
    moved = components(over).select(F.col("node").alias("__old"), F.col("root").alias("__new"))
    known = roots.unionByName(
        moved.select(F.col("__old").alias("node"), F.col("__old").alias("root"))
    ).dropDuplicates(["node", "root"])
    # A root that was a node of its own is now listed with itself; its old row, if any, is the same.
    return stored(
        known.join(moved, F.col("root") == F.col("__old"), "left").select(
            "node", F.coalesce("__new", "root").alias("root")
        ).distinct(),
        "joined",
    )


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The (a, b, alike) of ``pairs`` whose ends are in different components."""
    one = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    two = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    return (
        pairs.join(one, "a", "left")
        .join(two, "b", "left")
        .where(F.coalesce("ra", "a") != F.coalesce("rb", "b"))
        .select("a", "b", "alike")
    )


def _best_of_each(pairs: DataFrame) -> DataFrame:
    """For either end of the ``pairs`` (a, b, alike) the pair that is most alike."""
    ends = pairs.withColumn("node", F.explode(F.array("a", "b")))
    return ends.groupBy("node").agg(F.max(F.struct("alike", "a", "b")).alias("p")).select("p.a", "p.b").distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents link if their sets of 5-word shingles share at least 75 % of their
    union; a component is what links reach, and is named by its smallest id.
    Empty and null texts have an empty set and link with nothing. Rows without
    an id take no part: component_id is null and they are kept. Rows that repeat
    an id are judged each by its own text. An empty table gives no rows.
    """
    signed = stored(signatures(docs, id_column, text), "signatures")
    usable = signed.where("doc_id IS NOT NULL AND node IS NOT NULL")
    nodes = stored(
        usable.groupBy("node").agg(
            F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")
        ),
        "nodes",
    )
    members = tree_rows(nodes)
    near = stored(neighbours(members, nodes), "neighbours")
    # Full sets of all nodes that any pair can need: those with company in a region.
    company = members.select("node").distinct()
    sets = stored(sets_of(docs, id_column, text, nodes.join(company, "node", "left_semi")), "sets")

    # First every node against the hub of what neighbours suggest; then, of the
    # neighbours still in different components, the best of each node; then all of
    # them; then whoever else shares a region.
    hubs = components(near)
    tried = stored(
        hubs.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")), "tried"
    )
    roots = _joined(None, stored(confirmed(tried, sets), "confirmed"))
    best = stored(_best_of_each(_apart(near.join(tried, ["a", "b"], "left_anti"), roots)), "best")
    roots = _joined(roots, stored(confirmed(best, sets), "confirmed"))
    others = _apart(near.join(tried.unionByName(best), ["a", "b"], "left_anti"), roots)
    roots = _joined(roots, stored(confirmed(others, sets), "confirmed"))
    roots = _joined(roots, stored(across(members, nodes, sets, roots), "across"))

    lowest = (
        usable.select("node", "doc_id")
        .join(roots, "node", "left")
        .groupBy(F.coalesce("root", "node").alias("root"))
        .agg(F.min("doc_id").alias("component_id"))
    )
    named = stored(
        nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        .join(stored(lowest, "lowest"), "root").select("node", "component_id"),
        "named",
    )
    alone = F.when(F.col("node").isNull(), F.col("doc_id"))
    return (
        signed.select("doc_id", "n_shingles", "node")
        .join(named, "node", "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", alone)))
        .select(
            "doc_id",
            "n_shingles",
            "component_id",
            F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
        )
    )
