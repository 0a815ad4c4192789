"""Exact top-k search by inner product on a pivot-distance index.

One more component makes all rows equally long, so that the largest inner
product is the smallest distance. Every row is keyed by its nearest pivot and
its distance to it; distances are cut into annuli. A query first visits the
annuli around its own distance, nearest first, until they hold k rows. From the
worst of those scores follows a radius, and an annulus is visited only if the
triangle inequality allows a row of it within the radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicspan.llm.common import stored

PIVOTS = 16  # rows with the lowest hash, at most
ANNULI = 8  # per pivot
BLOCK = 1024  # rows of a block, and about as many queries of a lot
SALTS = 16  # copies of a lot of queries, for as many tasks at least
EXACT = float(1 << 53)


def integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    """False for vectors that are null or hold a null or non-finite component."""
    infinite = F.array(*[F.lit(float(v)) for v in ("inf", "-inf", "nan")])
    return F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.array_contains(infinite, x.cast("double"))),
        F.lit(False),
    )


def _matrix(lists: pd.Series, width: int, dtype=np.float64) -> np.ndarray:
    """Rows as a matrix; short ones are filled up with 0."""
    out = np.zeros((len(lists), width), dtype=dtype)
    for i, row in enumerate(lists):
        out[i, : len(row)] = row
    return out


def _unpacked(packed: pd.Series | list, width: int, kind: str) -> np.ndarray:
    """Rows as a matrix of integers, from their bytes."""
    return np.frombuffer(b"".join(packed), dtype=kind).reshape(len(packed), width).astype(np.int64)


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (rows**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int):
    """Row, id and score of the k best of each row, ties to the smaller id, without ``own``."""
    scores = scores.astype(np.float64) if scores.dtype != np.int64 else scores
    out_row, out_id, out_score = [], [], []
    for i in range(len(scores)):
        other = np.flatnonzero(ids != own[i])
        s = scores[i][other]
        if len(s) > k:
            cut = np.partition(s, len(s) - k)[len(s) - k]
            near = np.flatnonzero(s >= cut)
        else:
            near = np.arange(len(s))
        order = near[np.lexsort((ids[other][near], -s[near]))][:k]
        out_row += [i] * len(order)
        out_id += ids[other][order].tolist()
        out_score += s[order].astype(np.int64).tolist()
    return out_row, out_id, out_score


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products; in floating point only where that is exact."""
    if len(queries) and len(rows) and queries.shape[1]:
        bound = np.abs(queries).max() * float(np.abs(rows).max()) * queries.shape[1]
        if bound < EXACT:
            return queries.astype(np.float64) @ rows.astype(np.float64).T
    return queries @ rows.T


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_column: str = "vec_id",
    vector: str = "vector",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of each query row.

    ``vector`` is an array of integers. The score is the inner product, ties go
    to the smaller id, rows with the query's own id are no candidates. Null
    vectors and ids take no part; equal rows count once; shorter vectors are
    filled up with 0. Queries with fewer than k candidates get all of them; an
    empty table gives no rows.

    The index is fitted on at most ``PIVOTS`` rows and holds every row. What
    tasks share is one row per annulus, ``PIVOTS * ANNULI`` at most. Blocks of
    rows meet blocks of the queries that may need them.
    """
    spark = vectors.sparkSession
    rows = stored(
        vectors.select(
            F.col(id_column).cast("long").alias("id"),
            F.col(vector).cast("array<long>").alias("v"),
            is_query.alias("q"),
        )
        .where(F.col("id").isNotNull() & F.col("v").isNotNull())
        .distinct(),
        "topk-rows",
    )
    # One pass for the width and the longest row; a bounded sample for the pivots.
    squared = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    highest = F.array_max(F.transform("v", lambda x: F.greatest(x, -x - 1)))
    shape = rows.agg(
        F.max(F.size("v")).alias("width"), F.max(squared).alias("longest"), F.max(highest).alias("highest")
    ).first()
    width, longest = shape["width"] or 0, float(shape["longest"] or 0.0)
    # Vectors travel as bytes of the narrowest kind of integer that holds them all.
    kind = next(k for k in ("<i2", "<i4", "<i8") if (shape["highest"] or 0) <= np.iinfo(k).max)
    sample = rows.orderBy(F.xxhash64("id"), "id", "v").limit(PIVOTS).select("v").toPandas()["v"]

    def lifted(m: np.ndarray) -> np.ndarray:
        """One more component, so that every row has the length of the longest."""
        rest = np.sqrt(np.maximum(longest - (m.astype(np.float64) ** 2).sum(1), 0))
        return np.column_stack([m.astype(np.float64), rest])

    pivots = np.unique(lifted(_matrix(sample, width)), axis=0) if len(sample) else np.zeros((0, width + 1))

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = _matrix(b["v"], width, np.int64)
            d = _distances(lifted(m), pivots)
            near = d.argmin(1)
            yield b.assign(
                v=[r.tobytes() for r in m.astype(kind)], pivot=near.astype(np.int32), dist=d[np.arange(len(b)), near]
            )

    keyed = stored(rows.mapInPandas(key, "id long, v binary, q boolean, pivot int, dist double"), "topk-keys")
    # Annuli of equal width between the nearest and the farthest row of a pivot.
    reach = keyed.groupBy("pivot").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"))
    ring = F.least(
        F.lit(ANNULI - 1),
        F.floor((F.col("dist") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-9)) * ANNULI),
    )
    ringed = (
        keyed.join(F.broadcast(reach), "pivot")  # PIVOTS rows at most
        .withColumn("annulus", (F.col("pivot") * ANNULI + ring).cast("int"))
        .drop("lo", "hi")
    )
    # Blocks of an annulus are runs of rows by distance.
    blocks = stored(_blocks(ringed), "topk-blocks")
    summary = (
        blocks.groupBy("annulus")
        .agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .orderBy("annulus")
        .toPandas()
    )
    ann, count = summary["annulus"].to_numpy(), summary["n"].to_numpy()
    low, high = summary["lo"].to_numpy(), summary["hi"].to_numpy()
    of_pivot = ann // ANNULI if len(ann) else np.zeros(0, dtype=int)

    def gaps(q: np.ndarray) -> np.ndarray:
        """Least distance that a row of each annulus can have from each query."""
        length = np.sqrt(np.maximum((q.astype(np.float64) ** 2).sum(1), 0))
        d = _distances(np.column_stack([q.astype(np.float64), np.zeros(len(q))]), pivots)[:, of_pivot]
        return np.maximum(0, np.maximum(d - high, low - d)), length

    def first_visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            gap, _ = gaps(_unpacked(b["v"], width, kind))
            visits = []
            for g in gap:
                order = np.argsort(g, kind="stable")
                upto = np.searchsorted(np.cumsum(count[order]), k + 1) + 1
                visits.append(ann[order[:upto]].tolist())
            yield b.assign(visits=visits)

    queries = keyed.where("q").select("id", "v")
    visiting = stored(queries.mapInPandas(first_visits, "id long, v binary, visits array<int>"), "topk-first")
    lots = _lots(queries, 1 + visiting.count() // BLOCK)
    first = stored(
        _search(visiting.select("id", F.explode("visits").alias("annulus")), lots, blocks, k, width, kind),
        "topk-found",
    )
    found = _ranked(first, k)
    bound = found.groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("worst")
    )

    def later_visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            gap, length = gaps(_unpacked(b["v"], width, kind))
            visits = []
            for g, size, worst, done in zip(gap, length, b["worst"], b["visits"], strict=True):
                # |q - v|^2 = |q|^2 + longest - 2 * score, with some room for rounding.
                if pd.isna(worst):
                    radius = np.inf
                else:
                    radius = np.sqrt(max(size**2 + longest - 2 * float(worst), 0.0)) * (1 + 1e-9) + 1e-6 * (
                        1 + np.sqrt(longest) + size
                    )
                visits.append(np.setdiff1d(ann[g <= radius], done).tolist())
            yield b.assign(visits=visits)[["id", "visits"]]

    limits = visiting.join(bound.withColumnRenamed("query_id", "id"), "id", "left")
    rest = limits.mapInPandas(later_visits, "id long, visits array<int>").select(
        "id", F.explode("visits").alias("annulus")
    )
    return _ranked(first.unionByName(_search(rest, lots, blocks, k, width, kind)), k)


def _blocks(ringed: DataFrame) -> DataFrame:
    """Rows of an annulus by distance, packed into blocks of ``BLOCK`` rows at most."""
    rows = ringed.repartitionByRange("annulus", "dist", "id").sortWithinPartitions("annulus", "dist", "id")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (annulus,), g in b.groupby(["annulus"]):
                for at in range(0, len(g), BLOCK):
                    part = g.iloc[at : at + BLOCK]
                    yield pd.DataFrame(
                        {
                            "annulus": [annulus],
                            "n": [len(part)],
                            "lo": [part["dist"].min()],
                            "hi": [part["dist"].max()],
                            "ids": [part["id"].tolist()],
                            "vs": [b"".join(part["v"])],
                        }
                    )

    return rows.select("annulus", "dist", "id", "v").mapInPandas(
        pack, "annulus int, n long, lo double, hi double, ids array<long>, vs binary"
    ).withColumn("block", F.xxhash64("annulus", "ids"))


def _lots(queries: DataFrame, lots: int) -> DataFrame:
    """Queries dealt by hash into lots of about ``BLOCK``, several copies of each."""
    return stored(
        queries.withColumn("lot", F.pmod(F.xxhash64("id"), F.lit(lots)))
        .groupBy("lot")
        .agg(F.collect_list(F.struct("id", "v")).alias("queries"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))),
        "topk-lots",
    ).withColumn("lots", F.lit(lots))


def _search(
    wanted: DataFrame, lots: DataFrame, blocks: DataFrame, k: int, width: int, kind: str
) -> DataFrame:
    """(query_id, vec_id, score): the k best of each wanted (query, annulus) and block.

    Ids of a lot that want the same annulus go together; a lot's vectors meet a
    block once. Pairs of block and lot are spread over the tasks one by one.
    """
    number = lots.select("lots").first()
    deal = F.pmod(F.xxhash64("id"), F.lit(number["lots"] if number else 1))
    ids = wanted.withColumn("lot", deal).groupBy("annulus", "lot").agg(F.collect_list("id").alias("wants"))
    pairs = (
        blocks.select("annulus", "block")
        .join(ids.hint("merge"), "annulus")
        .withColumn("salt", F.pmod(F.xxhash64("block", "lot"), F.lit(SALTS)).cast("int"))
    )
    met = (
        pairs.join(lots.drop("lots").hint("merge"), ["lot", "salt"])
        .join(blocks.select("block", "ids", "vs").hint("merge"), "block")
        .repartition("block", "lot")
    )

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, vs, wants, queries in zip(b["ids"], b["vs"], b["wants"], b["queries"], strict=True):
                chosen = set(wants)
                queries = [q for q in queries if q["id"] in chosen]
                own = np.array([q["id"] for q in queries], dtype=np.int64)
                left = _unpacked([q["v"] for q in queries], width, kind)
                right = _unpacked([vs], width * len(ids), kind).reshape(len(ids), width)
                i, found, score = _best(_products(left, right), np.asarray(ids, dtype=np.int64), own, k)
                yield pd.DataFrame({"query_id": own[np.asarray(i, dtype=int)], "vec_id": found, "score": score}).astype("int64")

    return met.select("ids", "vs", "wants", "queries").mapInPandas(
        meet, "query_id long, vec_id long, score long"
    )


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query."""
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), F.lit(1), F.lit(k))
    return (
        found.groupBy("query_id")
        .agg(best.alias("best"))
        .select("query_id", F.posexplode("best").alias("at", "b"))
        .select(
            "query_id",
            (F.col("at") + 1).cast("int").alias("rank"),
            F.col("b.vec_id").alias("vec_id"),
            (-F.col("b.s")).alias("score"),
        )
    )
