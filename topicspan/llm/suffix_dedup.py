"""Repeated byte strings by prefix doubling over chosen positions.

Ranking every byte position would shuffle sixteen bytes for each byte of text in
every round. So the positions that are sorted are anchors: in every window of
``LENGTH`` bytes the position with the lowest hash of the ``GRAM`` bytes there.
Equal windows have the same anchor at the same place, so nothing is lost.

An anchor stands for the run of windows that it is lowest in. Rounds compare
strings around anchors, longer ones each time: its gram; the hull of all windows
it can stand for; then, where these disagree, cells of ``CELL`` windows, each by
the string that its windows share and by their hull; then single windows. A
string that is unique ends the search, a hull that is not settles all its
windows, and only what is left goes to the next round. Ranks are hashes of 128
bits, together with the gram's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField

from topicspan.llm.common import stored, texts_of, with_columns_of

LENGTH = 400
GRAM = 32
REACH = LENGTH - GRAM  # farthest that an anchor lies from the start of its window
CELL = 16
SEGMENT = 1 << 20  # windows that are looked at together

_rng = np.random.default_rng(20240602)
_TABLE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9FB21C651E98DF25)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64)))):
            steps = np.full(n + n // 2, base, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0], _powers[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hashes:
    """Hashes of any part of some bytes, from sums over their prefixes."""

    def __init__(self, data: np.ndarray):
        self.power, self.inverse = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_TABLE[data] * self.power[: len(data)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[begin]) * self.inverse[begin])


def _lowest(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` keys in a row, by running minima of blocks."""
    n = len(keys)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = keys
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - width + 1
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def anchors(data: np.ndarray, unique: int) -> list[np.ndarray]:
    """Position, first and last window, gram hash and hull hash of each anchor.

    Where the hull reaches over an end of the text, its hash is that of the
    text's ``unique`` number and the position.
    """
    out: list[list[np.ndarray]] = []
    windows = len(data) - LENGTH + 1
    last_bits = np.uint64((1 << 21) - 1)
    for start in range(0, max(windows, 0), SEGMENT):
        stop = min(windows, start + SEGMENT)
        low, high = max(0, start - REACH), min(len(data), stop + 2 * LENGTH)
        h = Hashes(data[low:high])
        at = np.arange(start - low, stop + REACH - low)
        grams = h.of(at, at + GRAM)
        places = np.arange(len(at), dtype=np.uint64)
        keys = (_mixed(grams + _BASE) & ~last_bits) | (last_bits - places)
        chosen = (last_bits - (_lowest(keys, REACH + 1) & last_bits)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
        last = np.r_[first[1:] - 1, len(chosen) - 1]
        pos = chosen[first] + start
        begin, end = pos - REACH, pos + LENGTH
        inside = (begin >= 0) & (end <= len(data))
        hull = _mixed(np.uint64(unique) ^ (pos.astype(np.uint64) * _BASE + np.uint64(1)))
        hull[inside] = h.of(begin[inside] - low, end[inside] - low)
        out.append([pos, first + start, last + start, grams[chosen[first]], hull])
    if not out:
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
    pos, one, two, gram, hull = (np.concatenate(parts) for parts in zip(*out, strict=True))
    # A run of windows that goes on in the next segment is one run.
    new = np.r_[True, pos[1:] != pos[:-1]]
    ends = np.r_[np.flatnonzero(new)[1:] - 1, len(pos) - 1]
    return [pos[new], one[new], two[ends], gram[new], hull[new]]


def _anchor_rows(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(doc_id, unit, digest, anchors): one row per row of ``docs``."""
    chosen = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text}`").alias("__text"))

    def maker() -> Callable[[pa.RecordBatch], Sequence]:
        unit = TaskContext.get().partitionId() << 40

        def find(batch: pa.RecordBatch) -> list:
            nonlocal unit
            units, digests, found = [], [], []
            for t in texts_of(batch, "__text"):
                data = t.encode()
                digest = hashlib.sha256(data).digest()
                units.append(unit)
                digests.append(digest)
                found.append(anchors(np.frombuffer(data, dtype=np.uint8), int.from_bytes(digest[:8], "little")))
                unit += 1
            columns = list(zip(*found, strict=True)) if found else [[]] * 5
            return [units, digests, *columns[:3], *[[h.view(np.int64) for h in c] for c in columns[3:]]]

        return find

    longs = ArrayType(LongType())
    fields = [StructField("unit", LongType()), StructField("digest", BinaryType())]
    fields += [StructField(c, longs) for c in ("pos", "first", "last", "gram", "hull")]
    return with_columns_of(chosen, ["doc_id"], fields, maker)


def _contexts(docs: DataFrame, id_column: str, text: str, wanted: DataFrame) -> DataFrame:
    """(unit, gram, pos, first, last, low, bytes): the bytes that hulls of anchors can cover."""
    keyed = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text}`").alias("__text"))
    lists = wanted.groupBy("unit", "doc_id", "digest").agg(
        F.collect_list(F.struct("pos", "gram", "first", "last")).alias("anchors")  # one text's anchors
    )
    rows = keyed.join(
        lists.select(F.col("doc_id").alias("__id"), "unit", "digest", "anchors"),
        F.col("doc_id").eqNullSafe(F.col("__id")),
    ).where(F.unhex(F.sha2("__text", 256)) == F.col("digest"))
    flat = rows.select("unit", "__text", *[F.col(f"anchors.{c}").alias(c) for c in ("pos", "gram", "first", "last")])

    def maker():
        def cut(batch: pa.RecordBatch) -> list:
            lows, parts = [], []
            for t, pos in zip(texts_of(batch, "__text"), batch.column("pos").to_pylist(), strict=True):
                data = t.encode()
                lows.append([max(0, p - REACH) for p in pos])
                parts.append([data[max(0, p - REACH) : p + LENGTH] for p in pos])
            return [lows, parts]

        return cut

    fields = [StructField("low", ArrayType(LongType())), StructField("bytes", ArrayType(BinaryType()))]
    names = ["pos", "gram", "first", "last", "low", "bytes"]
    return (
        with_columns_of(flat, ["unit", "pos", "gram", "first", "last"], fields, maker)
        .select("unit", F.explode(F.arrays_zip(*names)).alias("a"))
        .select("unit", *[f"a.{c}" for c in names])
    )


def _numbers(batch: pa.RecordBatch, *columns: str) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]


def _joined_bytes(batch: pa.RecordBatch) -> tuple[Hashes, np.ndarray, np.ndarray]:
    parts = batch.column("bytes").to_pylist()
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    return Hashes(np.frombuffer(b"".join(parts), dtype=np.uint8)), np.cumsum(sizes) - sizes, sizes


def _lists(values: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    return np.split(values, np.cumsum(sizes)[:-1]) if len(sizes) else []


def _cells(contexts: DataFrame) -> DataFrame:
    """(unit, pos, gram, cell, core, hull, first, last): cells of the windows of each anchor."""

    def maker():
        def cut(batch: pa.RecordBatch) -> list:
            h, base, sizes = _joined_bytes(batch)
            pos, first, last, low, unit = _numbers(batch, "pos", "first", "last", "low", "unit")
            from_, to = (pos - last) // CELL, (pos - first) // CELL
            number = to - from_ + 1
            of = np.repeat(np.arange(len(pos)), number)
            cell = np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number) + from_[of]
            zero = base[of] + pos[of] - low[of]  # the anchor's place in the joined bytes
            near, far = zero - cell * CELL, zero - cell * CELL - (CELL - 1)
            core = h.of(near, far + LENGTH)
            inside = (far >= base[of]) & (near + LENGTH <= base[of] + sizes[of])
            hull = _mixed(
                _mixed(unit[of].astype(np.uint64) * _BASE) ^ (pos[of].astype(np.uint64) * np.uint64(512) + cell.astype(np.uint64))
            )
            hull[inside] = h.of(far[inside], near[inside] + LENGTH)
            one = np.maximum(first[of], pos[of] - cell * CELL - (CELL - 1))
            two = np.minimum(last[of], pos[of] - cell * CELL)
            return [_lists(x, number) for x in (cell, core.view(np.int64), hull.view(np.int64), one, two)]

        return cut

    names = ["cell", "core", "hull", "from", "to"]
    fields = [StructField(c, ArrayType(LongType())) for c in names]
    return (
        with_columns_of(contexts, ["unit", "pos", "gram"], fields, maker)
        .select("unit", "pos", "gram", F.explode(F.arrays_zip(*names)).alias("c"))
        .select("unit", "pos", "gram", "c.cell", "c.core", "c.hull", F.col("c.from").alias("first"), F.col("c.to").alias("last"))
    )


def _windows(contexts: DataFrame) -> DataFrame:
    """(unit, gram, place, hash, first): every window of the cells in ``contexts`` (..., first, last)."""

    def maker():
        def cut(batch: pa.RecordBatch) -> list:
            h, base, _ = _joined_bytes(batch)
            pos, first, last, low = _numbers(batch, "pos", "first", "last", "low")
            number = last - first + 1
            of = np.repeat(np.arange(len(pos)), number)
            start = np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number) + first[of]
            at = base[of] + start - low[of]
            hashes = h.of(at, at + LENGTH)
            return [_lists(x, number) for x in (pos[of] - start, hashes.view(np.int64), start)]

        return cut

    names = ["place", "hash", "start"]
    fields = [StructField(c, ArrayType(LongType())) for c in names]
    return (
        with_columns_of(contexts, ["unit", "gram"], fields, maker)
        .select("unit", "gram", F.explode(F.arrays_zip(*names)).alias("w"))
        .select("unit", "gram", "w.place", "w.hash", F.col("w.start").alias("first"), F.col("w.start").alias("last"))
    )


def _ranked(rows: DataFrame, wide: Sequence[str], narrow: Sequence[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Settled runs and what the next round compares.

    ``wide`` names a string that contains all windows of a row, ``narrow`` one
    that all of them contain. Rows whose wide string repeats are settled. Of each
    wide string one row goes on if its narrow string has others, of which at
    least one is not settled.
    """
    keys = [*narrow, *[c for c in wide if c not in narrow]]
    others = [c for c in rows.columns if c not in keys]
    groups = stored(
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*others)).alias("one")), f"{name}-ranks"
    )
    twice = groups.where("n > 1").select(*keys)
    settled = rows.join(twice, keys, "left_semi").select("unit", "first", "last")
    classes = stored(
        groups.groupBy(*narrow)
        .agg(F.count(F.lit(1)).alias("strings"), F.min("n").alias("fewest"))
        .where("strings > 1 AND fewest = 1")
        .select(*narrow),
        f"{name}-classes",
    )
    going_on = groups.join(classes, list(narrow), "left_semi").select(*keys, "one.*")
    return settled, going_on


def repeated_runs(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(unit, doc_id, digest) of all rows, and (unit, first, last): runs of windows that repeat.

    A window repeats if its bytes start anywhere else, in the same text or
    another; rows with equal texts are different texts.
    """
    found = stored(_anchor_rows(docs, id_column, text), "anchors")
    units = found.select("unit", "doc_id", "digest")
    names = ["pos", "first", "last", "gram", "hull"]
    every = found.select("unit", F.explode(F.arrays_zip(*names)).alias("a")).select("unit", *[f"a.{c}" for c in names])
    repeated = stored(every.groupBy("gram").count().where("count > 1").select("gram"), "grams")
    rows = stored(every.join(repeated, "gram", "left_semi").select("unit", *names), "gram-rows")

    settled, open_anchors = _ranked(rows, ["hull"], ["gram"], "hull")
    whole = stored(settled, "hull-settled")
    wanted = open_anchors.join(units, "unit").select("unit", "doc_id", "digest", "pos", "gram", "first", "last")
    contexts = stored(_contexts(docs, id_column, text, wanted), "contexts")

    cells = stored(_cells(contexts), "cells")
    settled, open_cells = _ranked(cells, ["hull"], ["gram", "cell", "core"], "cell")
    in_cells = stored(settled, "cell-settled")
    at_cells = open_cells.select("unit", "pos", F.col("first").alias("__f"), F.col("last").alias("__l"))
    narrowed = (
        contexts.drop("first", "last")
        .join(at_cells, ["unit", "pos"])
        .withColumnRenamed("__f", "first")
        .withColumnRenamed("__l", "last")
    )
    windows = stored(_windows(narrowed), "windows")
    twice = windows.groupBy("gram", "place", "hash").count().where("count > 1").drop("count")
    single = windows.join(stored(twice, "window-ranks"), ["gram", "place", "hash"], "left_semi")
    runs = whole.unionByName(in_cells).unionByName(single.select("unit", "first", "last"))
    return units, runs


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept (bytes), kept_sha256.

    Every byte is removed that a string of ``LENGTH`` bytes covers which also
    starts elsewhere, judged on the input. Null texts are empty. ``n_spans``
    counts maximal removed runs. Rows without an id, and repeated rows, are texts
    like any other; an empty table gives no rows.
    """
    units, runs = repeated_runs(docs, id_column, text)
    per_unit = runs.groupBy("unit").agg(F.collect_list(F.struct("first", "last")).alias("runs"))  # one text's
    # Equal texts have equal runs.
    per_text = stored(
        per_unit.join(units.groupBy("digest").agg(F.min("unit").alias("unit")), "unit").select(
            F.col("digest").alias("__digest"), "runs.first", "runs.last"
        ),
        "text-runs",
    )
    rows = docs.select(
        F.col(f"`{id_column}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text")
    ).withColumn("__key", F.unhex(F.sha2("__text", 256)))
    joined = rows.join(per_text, F.col("__key") == F.col("__digest"), "left")

    def maker():
        def remove(batch: pa.RecordBatch) -> list:
            out: list[list] = [[], [], [], [], []]
            lists = (batch.column("first").to_pylist(), batch.column("last").to_pylist())
            for t, first, last in zip(texts_of(batch, "__text"), *lists, strict=True):
                data = t.encode()
                kept, removed, spans = data, 0, 0
                if first:
                    edges = np.zeros(len(data) + 1, dtype=np.int64)
                    np.add.at(edges, np.array(first), 1)
                    np.add.at(edges, np.array(last) + LENGTH, -1)
                    gone = np.cumsum(edges[:-1]) > 0
                    removed = int(gone.sum())
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
                for column, value in zip(
                    out, (len(data), removed, spans, kept, hashlib.sha256(kept).hexdigest()), strict=True
                ):
                    column.append(value)
            return out

        return remove

    fields = [
        StructField("n_bytes", LongType()),
        StructField("n_removed", LongType()),
        StructField("n_spans", LongType()),
        StructField("kept", BinaryType()),
        StructField("kept_sha256", StringType()),
    ]
    return with_columns_of(joined.select("doc_id", "__text", "first", "last"), ["doc_id"], fields, maker)
