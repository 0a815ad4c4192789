"""A topic model kept as tables: online variational LDA without a driver-side vocabulary.

The model is the table ``lam`` of (word, lam): per word its k variational
topic weights. Nothing of size V passes the driver; it only holds the k topic
sums. Documents are dealt into blocks by hash (``blocked``), about
``BLOCK_ENTRIES`` (document, word) pairs each, in which words are numbered. One
iteration (Hoffman, Blei and Bach's online variational Bayes, with every
document in every batch):

1. each block gets the weights of its own words, once for all its documents,
   and makes ``Elog beta`` of them and the k topic sums;
2. a fixed point on gamma, for many documents at once, gives each word's share
   of the sufficient statistics, added up per word inside the block and then
   across blocks;
3. lam <- (1 - rho) lam + rho (eta + D / |batch| * stats * exp(Elog beta)),
   rho = (tau0 + t) ^ -kappa, as one SQL expression per word.

Inference is the same step with the weights held fixed; the
variational bound (for log perplexity) is a sum over documents plus a sum
over the words of the model.

The per-document fixed point runs in NumPy inside tasks: Spark has no
digamma. Starting points are deterministic: gamma = alpha + n_d / k, and
lam = 1 + 0.1 * u(word, topic, seed) with u uniform in [0, 1) from a hash of
word, topic and seed, so two fits on any partitioning agree.

Defined results: documents without words have no posterior rows and add
nothing; an empty token table gives an empty model; counts of 0 or less are
left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from topicspan.operators.tokens import token_counts
from topicspan.session import discard, scratch_path, settled

SEED = 1234
TAU0, KAPPA = 1024.0, 0.51
GAMMA_TOL, GAMMA_ITERS = 1e-3, 100
# (document, word) pairs of a block: what one task holds at a time.
BLOCK_ENTRIES = 1_000_000
# Pairs of those whose arrays a task works on together; they fit its cache.
CHUNK_ENTRIES = 20_000


def digamma(x: np.ndarray) -> np.ndarray:
    """psi(x) for x > 0: recurrence up to 10, then the asymptotic series.
    At 0 (the topic sums of an empty model) it is -inf, without a warning."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return _digamma(x)


def _digamma(x: np.ndarray) -> np.ndarray:
    x = np.array(x, dtype="float64", copy=True)
    shift = np.zeros_like(x)
    for _ in range(10):
        small = x < 10
        if not small.any():
            break
        shift[small] -= 1.0 / x[small]
        x[small] += 1.0
    f = 1.0 / (x * x)
    series = f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))
    return shift + np.log(x) - 0.5 / x - series


def _lgamma(x) -> np.ndarray:
    a = np.asarray(x, dtype="float64")
    return np.array([math.lgamma(v) for v in a.ravel()], dtype="float64").reshape(a.shape)


def dirichlet_expectation(a: np.ndarray) -> np.ndarray:
    return digamma(a) - digamma(np.sum(a, axis=-1, keepdims=True))


def document_step(eb: np.ndarray, cts: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fixed point of one document: its gamma and per word ``exp(Elog theta) * cts / phinorm``.

    ``eb`` is (words, k) of exp(Elog beta), ``cts`` the counts.
    """
    k = alpha.shape[0]
    gamma = alpha + cts.sum() / k
    elt = np.exp(dirichlet_expectation(gamma))
    phinorm = eb @ elt + 1e-100
    for _ in range(GAMMA_ITERS):
        last = gamma
        gamma = alpha + elt * (eb.T @ (cts / phinorm))
        elt = np.exp(dirichlet_expectation(gamma))
        phinorm = eb @ elt + 1e-100
        if np.mean(np.abs(gamma - last)) < GAMMA_TOL:
            break
    return gamma, np.outer(cts / phinorm, elt)


def document_bound(eb_log: np.ndarray, cts: np.ndarray, gamma: np.ndarray, alpha: np.ndarray) -> float:
    """The document's part of the variational bound; ``eb_log`` is Elog beta (words, k)."""
    elog_theta = dirichlet_expectation(gamma)
    z = elog_theta[None, :] + eb_log
    top = z.max(axis=1, keepdims=True)
    lse = (top[:, 0] + np.log(np.exp(z - top).sum(axis=1)))
    bound = float(cts @ lse)
    bound += float(np.sum((alpha - gamma) * elog_theta))
    bound += float(np.sum(_lgamma(gamma) - _lgamma(alpha)))
    bound += math.lgamma(float(alpha.sum())) - math.lgamma(float(gamma.sum()))
    return bound


@dataclass(frozen=True)
class TopicTable:
    lam: DataFrame  # (word, lam array<double>)
    topics: int
    alpha: float
    eta: float
    iterations: int


def _start(topics: int, seed: int):
    u = lambda i: (F.abs(F.xxhash64("word", F.lit(i), F.lit(seed))) % 1_000_000) / 1_000_000.0
    return F.array(*[1.0 + 0.1 * u(i) for i in range(topics)])


def initial_weights(tokens: DataFrame, topics: int, seed: int = SEED) -> DataFrame:
    words = tokens.where(F.col("n") > 0).select("word").distinct()
    return words.select("word", _start(topics, seed).alias("lam"))


def topic_sums(lam: DataFrame, topics: int) -> np.ndarray:
    """The k sums of the weights over all words: k numbers to the driver."""
    row = lam.agg(*[F.sum(F.col("lam")[i]).alias(f"s{i}") for i in range(topics)]).first()
    return np.array([row[f"s{i}"] or 0.0 for i in range(topics)], dtype="float64")


@dataclass(frozen=True)
class Blocks:
    """A token table dealt into blocks.

    ``docs`` has one row per document with its words by their number in the
    block, and stays in the partition of its block; ``words`` has (word, at),
    ``at`` being the blocks that hold the word and its numbers there.
    """

    docs: DataFrame  # (block, docid, ids array<int>, cts array<long>)
    words: DataFrame  # (word, at array<struct<block, local>>, df)
    count: int


def blocked(tokens: DataFrame, counts: bool = True) -> Blocks:
    """Deal (docid, word, n) into blocks; counts of 0 or less are left out.

    Without ``counts`` n is any number, and every row stays.
    """
    spark = tokens.sparkSession
    number_type = LongType() if counts else DoubleType()
    known = tokens.where((F.col("n") > 0) & F.col("word").isNotNull()) if counts else tokens
    path = scratch_path(spark, "topic-tokens")
    kept = settled(known.select("docid", "word", F.col("n").cast(number_type).alias("n")), "topic-tokens", path)
    entries = kept.count()
    tasks = spark.sparkContext.defaultParallelism
    # Small tables still give every task a block.
    count = max(1, math.ceil(entries / BLOCK_ENTRIES), min(tasks, math.ceil(entries / 20_000)))
    schema = StructType(
        [
            StructField("block", IntegerType()),
            kept.schema["docid"],
            StructField("ids", ArrayType(IntegerType())),
            StructField("cts", ArrayType(number_type)),
            StructField("word", StringType()),
            StructField("local", IntegerType()),
            StructField("df", LongType()),
        ]
    )

    def number(key: tuple, rows: pa.Table) -> pa.Table:
        return _numbered(rows, int(key[0].as_py()))

    block = F.pmod(F.xxhash64("docid"), F.lit(count)).cast("int")
    dealt = kept.withColumn("block", block).repartitionById(count, F.col("block"))
    both = settled(dealt.groupBy("block").applyInArrow(number, schema), "topic-blocks")
    discard(spark, path)
    docs = both.where(F.col("ids").isNotNull()).select("block", "docid", "ids", "cts")
    words = both.where(F.col("ids").isNull()).groupBy("word").agg(
        F.collect_list(F.struct("block", "local")).alias("at"), F.sum("df").alias("df")
    )
    docs = docs.repartitionById(count, F.col("block")).persist(StorageLevel.MEMORY_AND_DISK)
    return Blocks(docs, words, count)


def _sorted_codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Each value's place among the distinct values, and these in order."""
    coded = column.combine_chunks().dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(coded.dictionary).to_numpy()
    places = np.empty(len(order), dtype=np.int64)
    places[order] = np.arange(len(order))
    return places[coded.indices.to_numpy()], coded.dictionary.take(pa.array(order))


def _numbered(rows: pa.Table, block: int) -> pa.Table:
    """One row per document, then one per word of a block."""
    doc, docids = _sorted_codes(rows.column("docid"))
    local, words = _sorted_codes(rows.column("word"))
    order = np.lexsort((local, doc))
    starts = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(docids))))).astype(np.int32)
    cts = rows.column("n").to_numpy()[order]
    n_docs, n_words = len(docids), len(words)
    ids = pa.ListArray.from_arrays(starts, pa.array(local[order].astype(np.int32)))
    counts = pa.ListArray.from_arrays(starts, pa.array(cts))
    documents = np.bincount(local, minlength=n_words).astype(np.int64)

    def column(own: pa.Array, before: int, after: int) -> pa.ChunkedArray:
        parts = [pa.nulls(before, own.type), own, pa.nulls(after, own.type)]
        return pa.chunked_array(parts, own.type)

    return pa.table(
        {
            "block": pa.array(np.full(n_docs + n_words, block, dtype=np.int32)),
            "docid": column(docids, 0, n_words),
            "ids": column(ids, 0, n_words),
            "cts": column(counts, 0, n_words),
            "word": column(words, n_docs, 0),
            "local": column(pa.array(np.arange(n_words, dtype=np.int32)), n_docs, 0),
            "df": column(pa.array(documents), n_docs, 0),
        }
    )


def _matrix(column: pa.ChunkedArray, topics: int) -> np.ndarray:
    """(topics, rows) of an array column whose arrays all have ``topics`` entries."""
    return pc.list_flatten(column).to_numpy().reshape(len(column), topics).T


def _entries(docs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the documents, and word numbers and counts of all in a row."""
    sizes = pc.list_value_length(docs.column("ids")).to_numpy().astype(np.int64)
    ids = pc.list_flatten(docs.column("ids")).to_numpy()
    return sizes, ids, pc.list_flatten(docs.column("cts")).to_numpy().astype(np.float64)


def _chunks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of documents with about ``CHUNK_ENTRIES`` pairs, one document at least."""
    upto = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        before = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, before + CHUNK_ENTRIES, side="right")))
        yield first, last
        first = last


def _log_expectation(a: np.ndarray) -> np.ndarray:
    """Dirichlet expectations of the columns of ``a``."""
    return digamma(a) - digamma(a.sum(axis=0))[None, :]


def documents_step(
    eb: np.ndarray, cts: np.ndarray, sizes: np.ndarray, alpha: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``document_step`` of many documents at once, none empty; topics are rows here.

    ``eb`` is (k, pairs). Gives gamma (k, documents), exp(Elog theta) and per
    pair cts / phinorm. A document stops when its own gamma has settled.
    """
    k = eb.shape[0]
    starts = np.cumsum(sizes) - sizes
    gamma = np.repeat((alpha + np.add.reduceat(cts, starts) / k)[None, :], k, axis=0)
    elt = np.exp(_log_expectation(gamma))
    ratio = cts / ((eb * np.repeat(elt, sizes, axis=1)).sum(axis=0) + 1e-100)
    at, pairs = np.arange(len(sizes)), np.arange(len(cts))
    out = gamma, elt, ratio
    done = [a.copy() for a in out]
    for _ in range(GAMMA_ITERS):
        last = gamma
        gamma = alpha + elt * np.add.reduceat(eb * ratio, starts, axis=1)
        elt = np.exp(_log_expectation(gamma))
        ratio = cts / ((eb * np.repeat(elt, sizes, axis=1)).sum(axis=0) + 1e-100)
        going = np.mean(np.abs(gamma - last), axis=0) >= GAMMA_TOL
        if going.all():
            continue
        wide = np.repeat(going, sizes)
        stop = ~going
        done[0][:, at[stop]], done[1][:, at[stop]] = gamma[:, stop], elt[:, stop]
        done[2][pairs[~wide]] = ratio[~wide]
        if not going.any():
            return done[0], done[1], done[2]
        at, pairs, sizes = at[going], pairs[wide], sizes[going]
        gamma, elt, eb = gamma[:, going], elt[:, going], eb[:, wide]
        cts, ratio = cts[wide], ratio[wide]
        starts = np.cumsum(sizes) - sizes
    done[0][:, at], done[1][:, at] = gamma, elt
    done[2][pairs] = ratio
    return done[0], done[1], done[2]


def _block_statistics(docs: pa.Table, eb: np.ndarray, alpha: float) -> np.ndarray:
    """(words, k): sums over the documents of a block of stats * exp(Elog beta)."""
    sizes, ids, cts = _entries(docs)
    out = np.zeros_like(eb)
    upto = np.concatenate(([0], np.cumsum(sizes)))
    for first, last in _chunks(sizes):
        part = slice(upto[first], upto[last])
        own = sizes[first:last]
        _, elt, ratio = documents_step(eb[:, ids[part]], cts[part], own, alpha)
        found, place = np.unique(ids[part], return_inverse=True)
        share = np.repeat(elt, own, axis=1) * ratio
        for j in range(len(eb)):
            out[j, found] += np.bincount(place, weights=share[j], minlength=len(found))
    return (out * eb).T


def _lists(values: np.ndarray) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(
        pa.array(np.arange(0, rows * width + 1, width, dtype=np.int32)), pa.array(values.ravel())
    )


def _at_blocks(lam: DataFrame, blocks: Blocks, columns: list[str]) -> DataFrame:
    """(block, local, columns): the rows of ``lam`` in every block that holds their word."""
    rows = lam.select(F.explode("at").alias("__at"), *columns)
    return rows.select("__at.block", "__at.local", *columns).repartitionById(blocks.count, F.col("block"))


def _sums(lam: DataFrame, sizes: list[int]) -> list[np.ndarray]:
    """The k sums of each model's weights: a few numbers to the driver."""
    named = [F.sum(F.col(f"m{j}")[i]).alias(f"s{j}_{i}") for j, k in enumerate(sizes) for i in range(k)]
    row = lam.agg(*named).first()
    return [np.array([row[f"s{j}_{i}"] or 0.0 for i in range(k)]) for j, k in enumerate(sizes)]


def _elog(weights: pa.Table, name: str, topics: int, psi: np.ndarray) -> np.ndarray:
    return digamma(_matrix(weights.column(name), topics)) - psi[:, None]


def _statistics(
    schema: StructType, sizes: list[int], psi: list[np.ndarray], alphas: list[float]
) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What a block does in an iteration: (wid, s0, s1, ...) of its words."""

    def run(docs: pa.Table, weights: pa.Table) -> pa.Table:
        weights = weights.sort_by("local")
        found = [weights.column("wid")]
        for j, (k, p, alpha) in enumerate(zip(sizes, psi, alphas, strict=True)):
            eb = np.exp(_elog(weights, f"m{j}", k, p))
            found.append(_lists(_block_statistics(docs, eb, alpha)))
        return pa.table(found, names=schema.names)

    return run


def _fit(
    blocks: Blocks, sizes: list[int], iterations: int, seed: int, alphas: list[float], etas: list[float]
) -> DataFrame:
    """(word, m0, m1, ...): the weights of a model of each size."""
    names = [f"m{j}" for j in range(len(sizes))]
    sums_of = [f"s{j}" for j in range(len(sizes))]
    starts = [_start(k, seed).alias(m) for k, m in zip(sizes, names, strict=True)]
    spark = blocks.docs.sparkSession
    first = scratch_path(spark, "topic-lam")
    lam = settled(
        blocks.words.select(F.monotonically_increasing_id().alias("wid"), "word", "at", *starts), "topic-lam", first
    )
    words = lam.select("wid", "word")
    lam, last = lam.drop("word"), None
    schema = StructType(
        [StructField("wid", LongType()), *[StructField(s, ArrayType(DoubleType())) for s in sums_of]]
    )
    for t in range(1, iterations + 1):
        psi = [digamma(s) for s in _sums(lam, sizes)]
        run = _statistics(schema, sizes, psi, alphas)
        sent = _at_blocks(lam, blocks, ["wid", *names])
        parts = blocks.docs.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(run, schema)
        stats = parts.groupBy("wid").agg(
            *[F.array(*[F.sum(F.col(s)[i]) for i in range(k)]).alias(s) for s, k in zip(sums_of, sizes, strict=True)]
        )
        rho = math.pow(TAU0 + t, -KAPPA)
        steps = [
            F.transform(m, _online_step(s, rho, eta)).alias(m)
            for m, s, eta in zip(names, sums_of, etas, strict=True)
        ]
        path = scratch_path(spark, "topic-lam")
        lam = settled(lam.join(stats, "wid", "left").select("wid", "at", *steps), "topic-lam", path)
        # Only the weights of the last iteration, and the words, are read again.
        if last:
            discard(spark, last)
        last = path
    model = settled(lam.join(words, "wid").select("word", *names), "topic-model")
    for path in (first, last):
        if path:
            discard(spark, path)
    return model


def _online_step(stats: str, rho: float, eta: float) -> Callable[[Column, Column], Column]:
    """One online step of a weight; ``stats`` are multiplied by exp(Elog beta) already."""
    return lambda x, i: (1.0 - rho) * x + rho * (eta + F.coalesce(F.col(stats)[i], F.lit(0.0)))


def fit_topic_table(
    tokens: DataFrame | Blocks,
    topics: int = 10,
    iterations: int = 20,
    seed: int = SEED,
    alpha: float | None = None,
    eta: float | None = None,
) -> TopicTable:
    """Fit on (docid, word, n); every document is in every batch."""
    alpha = 1.0 / topics if alpha is None else alpha
    eta = 1.0 / topics if eta is None else eta
    blocks = tokens if isinstance(tokens, Blocks) else blocked(tokens)
    lam = _fit(blocks, [topics], iterations, seed, [alpha], [eta])
    return TopicTable(lam.withColumnRenamed("m0", "lam"), topics, alpha, eta, iterations)


def beta_table(model: TopicTable) -> DataFrame:
    """(topic, term, beta): k rows per word, topics counted from 1; each topic sums to 1."""
    sums = topic_sums(model.lam, model.topics)
    s = F.array(*[F.lit(float(v)) for v in sums])
    rows = model.lam.select("word", F.posexplode("lam").alias("i", "w"))
    return rows.select(
        (F.col("i") + 1).alias("topic"), F.col("word").alias("term"), (F.col("w") / s[F.col("i")]).alias("beta")
    )


def infer(model: TopicTable, tokens: DataFrame | Blocks) -> DataFrame:
    """(docid, gamma, bound, n_tokens): per document with a known word its variational
    parameters and its part of the bound, under fixed weights."""
    blocks = tokens if isinstance(tokens, Blocks) else blocked(tokens)
    k, alpha = model.topics, model.alpha
    psi = digamma(topic_sums(model.lam, k))
    docid = blocks.docs.schema["docid"]
    schema = StructType(
        [
            docid,
            StructField("gamma", ArrayType(DoubleType())),
            StructField("bound", DoubleType()),
            StructField("n_tokens", LongType()),
        ]
    )

    def score(docs: pa.Table, weights: pa.Table) -> pa.Table:
        sizes, ids, cts = _entries(docs)
        local = weights.column("local").to_numpy()
        width = int(max(ids.max(initial=-1), local.max(initial=-1))) + 1
        elog, known = np.zeros((k, width)), np.zeros(width, dtype=bool)
        if len(local):
            elog[:, local], known[local] = _elog(weights, "lam", k, psi), True
        # Words that the model does not know are no part of a document.
        mine = known[ids]
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[mine], minlength=len(sizes))
        ids, cts, kept = ids[mine], cts[mine], sizes > 0
        sizes = sizes[kept]
        upto = np.concatenate(([0], np.cumsum(sizes)))
        gammas, bounds, counts = [np.zeros((0, k))], [np.zeros(0)], [np.zeros(0)]
        for first, last in _chunks(sizes):
            part, own = slice(upto[first], upto[last]), sizes[first:last]
            el = elog[:, ids[part]]
            gamma, _, _ = documents_step(np.exp(el), cts[part], own, alpha)
            gammas.append(gamma.T)
            bounds.append(_bounds(el, cts[part], own, gamma, alpha))
            counts.append(np.add.reduceat(cts[part], upto[first:last] - upto[first]))
        return pa.table(
            [
                docs.column("docid").filter(pa.array(kept)),
                _lists(np.concatenate(gammas)),
                pa.array(np.concatenate(bounds)),
                pa.array(np.concatenate(counts).astype(np.int64)),
            ],
            names=schema.names,
        )

    sent = _at_blocks(blocks.words.join(model.lam, "word"), blocks, ["lam"])
    return blocks.docs.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(score, schema)


def _bounds(el: np.ndarray, cts: np.ndarray, sizes: np.ndarray, gamma: np.ndarray, alpha: float) -> np.ndarray:
    """``document_bound`` of many documents at once; topics are rows here."""
    k = len(gamma)
    theta = _log_expectation(gamma)
    z = np.repeat(theta, sizes, axis=1) + el
    top = z.max(axis=0)
    lse = top + np.log(np.exp(z - top).sum(axis=0))
    bound = np.add.reduceat(cts * lse, np.cumsum(sizes) - sizes)
    bound += ((alpha - gamma) * theta).sum(axis=0) + (_lgamma(gamma) - math.lgamma(alpha)).sum(axis=0)
    return bound + math.lgamma(alpha * k) - _lgamma(gamma.sum(axis=0))


def posterior_table(model: TopicTable, tokens: DataFrame | Blocks) -> DataFrame:
    """(docid, topic, probability): normalised gamma, k rows per document."""
    g = infer(model, tokens)
    total = F.aggregate("gamma", F.lit(0.0), lambda acc, x: acc + x)
    return g.select("docid", F.posexplode("gamma").alias("i", "g"), total.alias("__t")).select(
        "docid", (F.col("i") + 1).alias("topic"), (F.col("g") / F.col("__t")).alias("probability")
    )


def topics_bound(model: TopicTable) -> float:
    """The model's part of the bound: a sum over words, added up in tasks."""
    k, eta = model.topics, model.eta
    psi_sums = digamma(topic_sums(model.lam, k))
    vocab = model.lam.count()
    schema = StructType([StructField("part", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = 0.0
        for b in batches:
            if b.num_rows == 0:
                continue
            w = b.column("lam").flatten().to_numpy().reshape(b.num_rows, k)
            elog = digamma(w) - psi_sums[None, :]
            part += float(np.sum((eta - w) * elog) + np.sum(_lgamma(w) - math.lgamma(eta)))
        yield pa.RecordBatch.from_arrays([pa.array([part])], ["part"])

    words_part = model.lam.select("lam").mapInArrow(run, schema).agg(F.sum("part")).first()[0] or 0.0
    sums = topic_sums(model.lam, k)
    return words_part + float(np.sum(math.lgamma(eta * vocab) - _lgamma(sums)))


def log_perplexity(model: TopicTable, tokens: DataFrame | Blocks) -> float:
    """-bound / tokens over the documents of ``tokens``, as Spark ML defines it."""
    docs = infer(model, tokens).agg(F.sum("bound").alias("b"), F.sum("n_tokens").alias("n")).first()
    if not docs["n"]:
        return float("nan")
    return -(docs["b"] + topics_bound(model)) / docs["n"]


def fit_topic_tables(
    tokens: DataFrame | Blocks, topic_counts: list[int], iterations: int = 20, seed: int = SEED
) -> dict[int, TopicTable]:
    """One model per topic count, all from one pass over the blocks per
    iteration: the weights of every model are columns of one table, and each
    task runs every model's fixed point on the documents it holds. Scans do not
    grow with the number of models; each equals ``fit_topic_table`` with
    alpha = eta = 1/k.
    """
    ks = list(dict.fromkeys(topic_counts))
    blocks = tokens if isinstance(tokens, Blocks) else blocked(tokens)
    priors = [1.0 / k for k in ks]
    lam = _fit(blocks, ks, iterations, seed, priors, priors)
    return {
        k: TopicTable(lam.select("word", F.col(f"m{j}").alias("lam")), k, 1.0 / k, 1.0 / k, iterations)
        for j, k in enumerate(ks)
    }


def numbered_rows(texts: DataFrame) -> DataFrame:
    """``texts`` with ``__row``, written once: ids may repeat or be null, rows are scored one by one."""
    return settled(texts.withColumn("__row", F.monotonically_increasing_id()), "topic-texts")


def row_blocks(rows: DataFrame) -> Blocks:
    """The words of numbered rows in blocks; each row is a document of its own."""
    return blocked(token_counts(rows.select(F.col("__row").alias("docid"), "text")))


def score_rows(model: TopicTable, texts: DataFrame) -> DataFrame:
    """The texts with their ``topicDistribution``, all zero for a text without a known word."""
    rows = numbered_rows(texts)
    blocks = row_blocks(rows)
    found = settled(infer(model, blocks).select(F.col("docid").alias("__row"), "gamma"), "topic-scores")
    blocks.docs.unpersist()
    total = F.aggregate("gamma", F.lit(0.0), lambda acc, x: acc + x)
    shares = F.transform("gamma", lambda x: x / total)
    nothing = F.array(*[F.lit(0.0)] * model.topics)
    return rows.join(found, "__row", "left").select(
        *texts.columns, array_to_vector(F.coalesce(shares, nothing)).alias("topicDistribution")
    )
