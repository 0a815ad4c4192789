"""Supervised classification of texts by label.

A feed-forward network on TF-IDF vectors, as a Spark ML pipeline. Spark's
network has sigmoid hidden layers, a softmax output and L-BFGS; it has no
dropout. All C classes are outputs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import (
    IDF,
    CountVectorizerModel,
    ElementwiseProduct,
    IndexToString,
    Normalizer,
    VectorSlicer,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from topicspan.operators.features import (
    fit_counter,
    has_words,
    idf_values,
    indexed_words,
    label_indexer,
    presence_counter,
    stop_word_stage,
    word_indices,
    word_stage,
)
from topicspan.operators.label_tables import (
    LabelTable,
    fit_network,
    row_word_blocks,
    start_weights,
)
from topicspan.operators.splits import DEFAULT_FRACTIONS, split_part, stratified_split
from topicspan.operators.tokens import english_stop_words, token_counts
from topicspan.operators.topic_tables import blocked, numbered_rows
from topicspan.session import checkpointed, settled

# Doubles in one dense block of stacked feature rows: 32 MB per task.
_BLOCK_VALUES = 1 << 22


def network_scores(network: MultilayerPerceptronClassificationModel, vectors: DataFrame) -> DataFrame:
    """``vectors`` with prediction and probability, as ``network.transform`` gives them.

    Spark's network turns each sparse row into a dense one with an entry for
    every word of the vocabulary; this one adds up the weights of the row's words.
    """
    sizes, weights = network.getLayers(), network.weights.toArray()

    def run(indices: pa.Array, values: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.list_value_length(indices), 0).to_numpy().astype(np.int64)
        at, by = indices.flatten().to_numpy(), values.flatten().to_numpy()
        row, begin, signal = np.repeat(np.arange(len(lengths)), lengths), 0, None
        for n_in, n_out in zip(sizes, sizes[1:], strict=False):
            matrix = weights[begin : begin + n_in * n_out].reshape(n_in, n_out)
            bias = weights[begin + n_in * n_out : begin + (n_in + 1) * n_out]
            begin += (n_in + 1) * n_out
            if signal is None:
                sums = [np.bincount(row, by * matrix[at, j], len(lengths)) for j in range(n_out)]
                signal = np.stack(sums, axis=1) + bias
            else:
                signal = (1.0 / (1.0 + np.exp(-signal))) @ matrix + bias
        shares = np.exp(signal - signal.max(axis=1, keepdims=True))
        shares /= shares.sum(axis=1, keepdims=True)
        upto = np.arange(0, shares.size + 1, sizes[-1], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(upto), pa.array(shares.ravel()))

    forward = F.arrow_udf(run, ArrayType(DoubleType()))
    entries = F.unwrap_udt("features")
    scored = vectors.withColumn("__p", forward(entries["indices"], entries["values"]))
    best = (F.array_position("__p", F.array_max("__p")) - 1).cast("double")
    return scored.withColumn("prediction", best).withColumn("probability", array_to_vector("__p")).drop("__p")


@dataclass(frozen=True)
class SparseScorer:
    """Text to label, as a pipeline; see :func:`network_scores`."""

    features: PipelineModel
    network: MultilayerPerceptronClassificationModel
    names: IndexToString

    def transform(self, texts: DataFrame) -> DataFrame:
        return self.names.transform(network_scores(self.network, self.features.transform(texts)))


@dataclass(frozen=True)
class LabelModel:
    """A trained classifier with what it takes to score and to extend it."""

    counter: CountVectorizerModel
    frequencies: list[int]
    documents: int
    classes: list[str]
    stop_words: tuple[str, ...]
    network: MultilayerPerceptronClassificationModel
    history: DataFrame
    splits: DataFrame

    def pipeline(self, idf: np.ndarray | None = None) -> PipelineModel:
        """Text to label with TF-IDF features; ``idf`` replaces the stored one."""
        return PipelineModel(
            [
                *_tf_idf_stages(self.counter, self._idf() if idf is None else idf, self.stop_words),
                self.network,
                self._names(),
            ]
        )

    def binary_pipeline(self) -> PipelineModel:
        """Text to label with 0/1 features and without stop word removal.

        Nothing about the corpus is needed, so it also serves streams.
        """
        presence = presence_counter(self.counter, "all_words", "features")
        return PipelineModel([word_stage(), presence, self.network, self._names()])

    def scorer(self, idf: np.ndarray | None = None) -> SparseScorer:
        """:meth:`pipeline` with a network that reads only the words a text has."""
        stages = _tf_idf_stages(self.counter, self._idf() if idf is None else idf, self.stop_words)
        return SparseScorer(PipelineModel(stages), self.network, self._names())

    def binary_scorer(self) -> SparseScorer:
        """:meth:`binary_pipeline` with a network that reads only the words a text has."""
        presence = presence_counter(self.counter, "all_words", "features")
        return SparseScorer(PipelineModel([word_stage(), presence]), self.network, self._names())

    def document_frequencies(self) -> DataFrame:
        """(termIndex, term, df): what a saved model needs to be extended."""
        spark = self.splits.sparkSession
        df = pd.DataFrame({"termIndex": range(len(self.frequencies)), "df": self.frequencies})
        found = spark.createDataFrame(df, "termIndex int, df long")
        return indexed_words(spark, self.counter.vocabulary).join(found, "termIndex")

    def _idf(self) -> np.ndarray:
        return idf_values(self.frequencies, self.documents)

    def _names(self) -> IndexToString:
        return IndexToString(inputCol="prediction", outputCol="predictTag", labels=self.classes)


def _tf_idf_stages(
    counter: CountVectorizerModel, idf: np.ndarray, stop_words: Sequence[str]
) -> list:
    """Word counts / document total * idf, all inside the row."""
    return [
        word_stage(),
        stop_word_stage(stop_words),
        counter,
        Normalizer(p=1.0, inputCol="counts", outputCol="tf"),
        ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="tf", outputCol="features"),
    ]


def layer_sizes(features: int, classes: int) -> list[int]:
    """Inputs, C/2 and C/4 hidden units (at least 2), C outputs."""
    return [features, max(2, classes // 2), max(2, classes // 4), classes]


def _network(layers: Sequence[int], iterations: int, seed: int) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(
        layers=list(layers),
        featuresCol="features",
        labelCol="label_index",
        maxIter=iterations,
        blockSize=max(1, min(128, _BLOCK_VALUES // layers[0])),
        seed=seed,
    )


def loss_and_accuracy() -> list[Column]:
    """Aggregates over rows with label_index, prediction and probability."""
    own = F.get(vector_to_array("probability"), F.col("label_index").cast("int"))
    hit = (F.col("prediction") == F.col("label_index")).cast("double")
    return [F.avg(_log_loss(own)).alias("loss"), F.avg(hit).alias("accuracy")]


def _log_loss(probability: Column) -> Column:
    """-ln(p), with p kept away from 0 and 1."""
    floor = F.lit(1e-15)
    return -F.log(F.least(F.greatest(probability, floor), F.lit(1.0) - floor))


def train_network(
    vectors: DataFrame,
    layers: Sequence[int],
    epochs: int = 50,
    epochs_per_step: int = 1,
    seed: int = 1234,
    fit_rows: int | None = None,
) -> tuple[MultilayerPerceptronClassificationModel, list[tuple[int, str, str, float]]]:
    """Train in steps of some epochs, one by default; score both sets after each.

    A step starts from the weights of the one before. L-BFGS begins anew with
    it and forgets the curvature it has seen, so steps of one epoch are steps of
    steepest descent with line search; ask for longer steps where the history
    of every epoch is not needed. The network is fitted on all training rows,
    which stay sparse (``label_tables``), from the start of Spark's network.

    A caller who wants a network of fewer rows names ``fit_rows``: it is then
    fitted by Spark on the training rows with the lowest hash of their id, and
    scored on all. Spark's network stacks rows to dense blocks. A word that no
    fitted row has gets no gradient, so a network of the other words is fitted
    from the same start and its weights are put back.
    """
    if fit_rows is None:
        return _train_on_all(vectors, layers, epochs, epochs_per_step, seed)
    train = split_part(vectors, "train")
    drawn = train.select("docid").orderBy(F.md5(F.col("docid").cast("string")), "docid").limit(fit_rows)
    train = train.join(drawn, "docid", "left_semi").persist(StorageLevel.MEMORY_AND_DISK)
    scored_sets = {"train": "training", "validation": "validation"}
    one = train.limit(1)
    used = np.array(
        [r["at"] for r in train.select(F.explode(word_indices("features")).alias("at")).distinct().collect()],
        dtype="int64",
    )
    used.sort()
    width, hidden = layers[0], layers[1]
    slicer = VectorSlicer(inputCol="features", outputCol="__own", indices=used.tolist())
    own = (
        slicer.transform(train)
        .select("label_index", F.col("__own").alias("features"))
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    model = _network(layers, 0, seed).fit(one)  # no step: the start
    history, done = [], 0
    while done < epochs:
        step = min(epochs_per_step, epochs - done)
        weights = model.weights.toArray().copy()
        first = weights[: width * hidden].reshape(width, hidden)
        start = np.concatenate([first[used].ravel(), weights[width * hidden :]])
        narrow = _network([len(used), *layers[1:]], step, seed).setInitialWeights(Vectors.dense(start))
        found = narrow.fit(own).weights.toArray()
        first[used] = found[: len(used) * hidden].reshape(len(used), hidden)
        weights[width * hidden :] = found[len(used) * hidden :]
        model = _network(layers, 0, seed).setInitialWeights(Vectors.dense(weights)).fit(one)
        done += step
        scored = network_scores(model, vectors.where(F.col("split").isin(*scored_sets)))
        for row in scored.groupBy("split").agg(*loss_and_accuracy()).collect():
            name = scored_sets[row["split"]]
            history += [(done, name, m, row[m]) for m in ("loss", "accuracy")]
    own.unpersist()
    train.unpersist()
    return model, history


def _train_on_all(
    vectors: DataFrame, layers: Sequence[int], epochs: int, epochs_per_step: int, seed: int
) -> tuple[MultilayerPerceptronClassificationModel, list[tuple[int, str, str, float]]]:
    """:func:`train_network` on all training rows; the weights come to the driver at the end."""
    spark, width, hidden = vectors.sparkSession, layers[0], layers[1]
    rows = numbered_rows(vectors.select("label_index", "split", "features"))
    features = F.unwrap_udt("features")
    # A row without a word takes part with the biases: it has the word -1, which weighs nothing.
    pairs = F.arrays_zip(word_indices("features").alias("at"), features["values"].alias("value"))
    none = F.array(F.struct(F.lit(-1).alias("at"), F.lit(0.0).alias("value")))
    entries = rows.select(
        F.col("__row").alias("docid"), F.explode(F.when(has_words("features"), pairs).otherwise(none)).alias("__e")
    ).select("docid", F.col("__e.at").cast("string").alias("word"), F.col("__e.value").alias("n"))
    blocks = blocked(entries, counts=False)
    meta = blocks.docs.select("block", F.col("docid").alias("__row")).join(rows.drop("features"), "__row")
    one = rows.limit(1)
    weights = _network(layers, 0, seed).fit(one).weights.toArray().copy()
    first = weights[: width * hidden].reshape(width, hidden)
    start = pd.DataFrame({"word": [str(i) for i in range(width)], "w0": list(first)})
    start = spark.createDataFrame(start, "word string, w0 array<double>")
    nothing = F.array(*[F.lit(0.0)] * hidden)
    starts = blocks.words.join(start, "word", "left").withColumn("w0", F.coalesce("w0", nothing))
    words, rest, history = fit_network(blocks, meta, starts, weights[width * hidden :], layers, epochs, epochs_per_step)
    blocks.docs.unpersist()
    found = words.where(F.col("word") != "-1").select(F.col("word").cast("int").alias("at"), "w").toPandas()
    if len(found):
        first[found["at"].to_numpy()] = np.stack(found["w"].to_numpy())
    weights[width * hidden :] = rest
    return _network(layers, 0, seed).setInitialWeights(Vectors.dense(weights)).fit(one), history


def train_labels(
    labelled: DataFrame,
    label: str = "label",
    fractions: Sequence[float] = DEFAULT_FRACTIONS,
    epochs: int = 50,
    epochs_per_step: int = 1,
    fit_rows: int | None = None,
    stop_words: Sequence[str] | None = None,
    seed: int = 1234,
) -> LabelModel:
    """Split, train and keep the history. ``labelled`` has docid, text, label."""
    listed = english_stop_words() if stop_words is None else tuple(stop_words)
    rows = labelled.select("docid", "text", F.col(label).alias("label")).na.drop("any")
    counter = fit_counter(token_counts(rows, listed))
    indexer = label_indexer(rows)
    if len(indexer.labels) < 2:
        raise ValueError(f"a classifier needs two classes, found {list(indexer.labels)}")
    plain = PipelineModel([indexer, word_stage(), stop_word_stage(listed), counter])
    # Persisted before it is filtered: the filter must not run the stages again.
    read = (
        plain.transform(rows)
        .select("docid", "label", "label_index", "counts")
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    counted = read.where(has_words("counts"))
    seen = IDF(inputCol="counts", outputCol="unused").fit(counted)
    frequencies, documents = seen.docFreq, seen.numDocs
    weights = PipelineModel(_tf_idf_stages(counter, idf_values(frequencies, documents), listed)[3:])
    weighted = (
        weights.transform(counted)
        .select("docid", "label", "label_index", "features")
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    vectors = stratified_split(weighted, "label", fractions, seed)
    splits = checkpointed(vectors.select("docid", "label", "split"))
    layers = layer_sizes(len(frequencies), len(indexer.labels))
    network, history = train_network(
        vectors,
        layers,
        epochs,
        epochs_per_step,
        seed,
        fit_rows,
    )
    weighted.unpersist()
    read.unpersist()
    return LabelModel(
        counter=counter,
        frequencies=frequencies,
        documents=documents,
        classes=list(indexer.labels),
        stop_words=listed,
        network=network,
        history=labelled.sparkSession.createDataFrame(
            history, "epoch int, data string, metric string, value double"
        ),
        splits=splits,
    )


def train_label_tables(
    labelled: DataFrame,
    label: str = "label",
    fractions: Sequence[float] = DEFAULT_FRACTIONS,
    epochs: int = 50,
    epochs_per_step: int = 1,
    stop_words: Sequence[str] | None = None,
    seed: int = 1234,
) -> LabelTable:
    """:func:`train_labels` with a model that is a table: no vocabulary on the driver.

    Starting weights come from hashes of words, so they differ from those of Spark's network.
    """
    listed = english_stop_words() if stop_words is None else tuple(stop_words)
    rows = numbered_rows(labelled.select("docid", "text", F.col(label).cast("string").alias("label")).na.drop("any"))
    classes = [r["label"] for r in rows.select("label").distinct().orderBy("label").collect()]
    if len(classes) < 2:
        raise ValueError(f"a classifier needs two classes, found {classes}")
    blocks = row_word_blocks(rows, listed)
    named = F.array(*[F.lit(c) for c in classes])
    seen = blocks.docs.select("block", F.col("docid").alias("__row")).join(rows.drop("text"), "__row")
    meta = settled(
        stratified_split(seen, "label", fractions, seed).withColumn(
            "label_index", F.array_position(named, F.col("label")) - 1
        ),
        "label-rows",
    )
    documents, words = meta.count(), blocks.words.count()
    if not words:
        raise ValueError("no training row has a word")
    layers = layer_sizes(words, len(classes))
    own, rest = start_weights(layers, seed)
    found, rest, history = fit_network(
        blocks, meta, blocks.words.withColumn("w0", own), rest, layers, epochs, epochs_per_step, documents
    )
    blocks.docs.unpersist()
    return LabelTable(
        words=found,
        rest=rest,
        layers=layers,
        documents=documents,
        classes=classes,
        stop_words=listed,
        history=labelled.sparkSession.createDataFrame(
            history, "epoch int, data string, metric string, value double"
        ),
        splits=meta.select("docid", "label", "split"),
    )


def history_by_epoch(history: DataFrame) -> DataFrame:
    """(epoch, trainLoss, trainAccuracy, valLoss, valAccuracy).

    One aggregate in place of two pivots and a join; epochs that were not
    scored on both sets drop out.
    """
    def pick(data: str, metric: str) -> Column:
        return F.max(F.when((F.col("data") == data) & (F.col("metric") == metric), F.col("value")))

    return (
        history.groupBy("epoch")
        .agg(
            pick("training", "loss").alias("trainLoss"),
            pick("training", "accuracy").alias("trainAccuracy"),
            pick("validation", "loss").alias("valLoss"),
            pick("validation", "accuracy").alias("valAccuracy"),
            F.count_if(F.col("data") == "training").alias("__t"),
            F.count_if(F.col("data") == "validation").alias("__v"),
        )
        .where((F.col("__t") > 0) & (F.col("__v") > 0))
        .drop("__t", "__v")
    )


def history_of(history: DataFrame, data: str) -> DataFrame:
    """(epoch, loss, accuracy) of the ``training`` or ``validation`` set."""
    return (
        history.where(F.col("data") == data)
        .groupBy("epoch")
        .pivot("metric", ["loss", "accuracy"])
        .agg(F.first("value"))
    )


def with_label_index(model: LabelModel | LabelTable, rows: DataFrame, label: str = "label") -> DataFrame:
    """Class numbers for known labels, in the order of the model's outputs."""
    classes = F.array(*[F.lit(c) for c in model.classes])
    at = F.array_position(classes, F.col(label))
    return rows.where(at > 0).withColumn("label_index", (at - 1).cast("double"))


def evaluate_labels(model: LabelModel | LabelTable, labelled: DataFrame, split: str = "test") -> DataFrame:
    """One row (loss, accuracy) for the documents of a split."""
    part = labelled.join(split_part(model.splits, split).select("docid"), "docid", "left_semi")
    # Only these columns: a corpus with topics has a ``probability`` of its own.
    rows = with_label_index(model, part.select("docid", "text", "label"))
    return model.scorer().transform(rows).agg(*loss_and_accuracy())


def split_predictions(model: LabelModel | LabelTable, labelled: DataFrame, split: str = "test") -> DataFrame:
    """(docid, label, predictTag, text, appTag if present) of a split."""
    part = labelled.join(split_part(model.splits, split).select("docid"), "docid", "left_semi")
    keep = [c for c in ("text", "appTag") if c in labelled.columns]
    rows = part.select("docid", "label", *keep)
    return model.scorer().transform(rows).select("docid", "label", "predictTag", *keep)


def join_predictions(predictions: DataFrame, corpus: DataFrame) -> DataFrame:
    """Predicted tags next to the corpus columns, by docid."""
    return predictions.select("docid", "label", "predictTag").join(corpus, "docid")


def accuracy_and_loss(predictions: DataFrame) -> DataFrame:
    """One row (loss, accuracy) from (label, predictTag, probability of label)."""
    return predictions.agg(
        F.avg(_log_loss(F.col("probability"))).alias("loss"),
        F.avg((F.col("label") == F.col("predictTag")).cast("double")).alias("accuracy"),
    )


def class_scores(predicted: DataFrame, classes: Sequence[str]) -> DataFrame:
    """(docid, rank, tags, probability): all classes of each text, best first."""
    names = F.array(*[F.lit(c) for c in classes])
    pairs = F.transform(
        vector_to_array("probability"),
        lambda x, i: F.struct((-x).alias("down"), i.alias("at"), F.get(names, i).alias("tags")),
    )
    return predicted.select("docid", F.posexplode(F.array_sort(pairs)).alias("__i", "__c")).select(
        "docid",
        (F.col("__i") + 1).alias("rank"),
        F.col("__c.tags").alias("tags"),
        (-F.col("__c.down")).alias("probability"),
    )


def classify_with_tf_idf(model: LabelModel | LabelTable, numbered: DataFrame) -> DataFrame:
    """Class scores of new texts, with idf over the corpus and these texts.

    Only the new texts are read. What they add to df and N is aggregated to
    the size of the vocabulary and added to the stored frequencies.
    """
    if isinstance(model, LabelTable):
        return class_scores(model.extended_scorer().transform(numbered.select("docid", "text")), model.classes)
    vectors = (
        PipelineModel([word_stage(), stop_word_stage(model.stop_words), model.counter])
        .transform(numbered)
        .select("counts")
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    seen = (
        vectors.select(F.explode(word_indices("counts")).alias("at"))
        .groupBy("at")
        .agg(F.count(F.lit(1)).alias("df"))
        .toPandas()
    )
    frequencies = np.asarray(model.frequencies, dtype="int64")
    frequencies[seen["at"].to_numpy(dtype="int64")] += seen["df"].to_numpy(dtype="int64")
    documents = model.documents + vectors.where(has_words("counts")).count()
    vectors.unpersist()
    scored = model.scorer(idf_values(frequencies, documents)).transform(numbered)
    return class_scores(scored, model.classes)


def classify_with_presence(model: LabelModel | LabelTable, numbered: DataFrame) -> DataFrame:
    """Class scores of new texts from word presence alone."""
    return class_scores(model.binary_scorer().transform(numbered.select("docid", "text")), model.classes)
