"""Line dedup over levelled sorted runs of line hashes.

Documents arrive in batches. Each batch is reduced to one *run*: a table of
(line hash, documents holding it, largest doc_id holding it), range-partitioned
and sorted by the hash. Runs sit on levels; a level that holds ``fanout`` runs
is compacted into one run on the next level by a merge of sorted inputs (a
union and a sum per hash). A new batch first merge-anti-joins its own run with
the runs already there, which names the lines it is the first to hold, and
then adds its run on level 0.

A line is dropped where its key is held by at least ``min_docs`` documents of
all batches and the document is not the largest doc_id holding it. Only the
line numbers to drop of each document are gathered, never its lines.

Defined results:

* null or empty text: one empty line, never dropped (its key is short);
* a null doc_id is a document of its own id, smaller than every other, so it
  never keeps a shared line; repeated rows of one doc_id are one document
  holding their lines, and each row is returned;
* a line repeated inside one document counts once for that document and is
  dropped in all its places unless that document is the keeper;
* keys are compared by their 128-bit MD5, so two keys are one only if equal
  (a collision has odds near 2^-128 per pair);
* empty tables give empty results; further input columns are kept aside and
  never clash with the operator's own names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicspan.llm.common import stored

# Fixed values of the contract.
MIN_KEY_CHARS = 20
MIN_DOCS = 3
# Documents of a batch, and runs of one level before they are compacted.
BATCH_DOCS = 2_000_000
FANOUT = 4
NO_DOC = -(2**63)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without spaces at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE_CHARS)), UPPER, LOWER)


def split_lines(text: Column) -> Column:
    """Lines at \\n; null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def numbered_lines(docs: DataFrame, min_key_chars: int = MIN_KEY_CHARS, extra: Sequence[str] = ()) -> DataFrame:
    """(doc, line_no, hash) of every line whose key is long enough to count."""
    lines = docs.select("__doc", *extra, F.posexplode(split_lines(F.col("__text"))).alias("line_no", "line"))
    key = line_key(F.col("line"))
    return lines.where(F.length(key) >= min_key_chars).select(
        "__doc", *extra, "line_no", F.unhex(F.md5(key)).alias("hash")
    )


def run_of(lines: DataFrame) -> DataFrame:
    """One run: per hash the documents holding it and the largest of them."""
    per_doc = lines.select("hash", "__doc").distinct()
    run = per_doc.groupBy("hash").agg(F.count("*").alias("n_docs"), F.max("__doc").alias("top_doc"))
    return run.repartitionByRange("hash").sortWithinPartitions("hash")


def merged(runs: Sequence[DataFrame]) -> DataFrame:
    """Runs of disjoint batches as one: counts add up, the largest doc wins."""
    union = runs[0]
    for r in runs[1:]:
        union = union.unionByName(r)
    total = union.groupBy("hash").agg(F.sum("n_docs").alias("n_docs"), F.max("top_doc").alias("top_doc"))
    return total.repartitionByRange("hash").sortWithinPartitions("hash")


@dataclass
class LineRuns:
    """Levelled runs of line hashes; ``levels[i]`` holds at most ``fanout`` runs."""

    fanout: int = FANOUT
    levels: list[list[DataFrame]] = field(default_factory=list)

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def add(self, lines: DataFrame) -> None:
        """Add a batch of (__doc, line_no, hash), whose doc_ids are all smaller
        than those of earlier batches.

        Its run is merge-anti-joined with the runs already there: hashes no
        earlier batch holds keep the batch's largest holder, the others only
        add their count, as a larger document holds them already.
        """
        own = run_of(lines)
        earlier = self.runs()
        if earlier:
            known = earlier[0].select("hash")
            for r in earlier[1:]:
                known = known.unionByName(r.select("hash"))
            fresh = own.join(known, "hash", "left_anti")
            repeated = own.join(known, "hash", "left_semi").withColumn("top_doc", F.lit(None).cast("long"))
            own = fresh.unionByName(repeated).repartitionByRange("hash").sortWithinPartitions("hash")
        self._push(0, stored(own, "line-run"))

    def _push(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._push(level + 1, stored(merged(full), "line-run"))

    def compacted(self) -> DataFrame | None:
        runs = self.runs()
        if not runs:
            return None
        return runs[0] if len(runs) == 1 else merged(runs)


def batch_bounds(docs: DataFrame, batch_docs: int) -> list[float]:
    """doc_id bounds that cut the documents into batches of about ``batch_docs``."""
    n = docs.count()
    batches = max(1, -(-n // batch_docs))
    if batches == 1:
        return []
    qs = [i / batches for i in range(1, batches)]
    return sorted(set(docs.approxQuantile("__doc", qs, 0.001)))


def dedup_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_docs: int = MIN_DOCS,
    min_key_chars: int = MIN_KEY_CHARS,
    batch_docs: int = BATCH_DOCS,
    fanout: int = FANOUT,
) -> DataFrame:
    """Per input row: doc_id, n_lines, n_dropped, kept_text, kept_sha256 and the
    input row but its text as struct ``row``.

    Batches are doc_id ranges, fed into the runs from the largest ids down; all
    rows of a doc_id land in one batch. Texts are read twice, never stored:
    once to hash their lines, which are stored, and once at the end; only the
    line numbers to drop travel, and the texts are shuffled once, to meet them.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_DOC)).alias("__doc"),
        F.col(text).alias("__text"),
    ).withColumn("__copy", F.xxhash64(F.coalesce(F.col("__text"), F.lit(""))))
    # Lines are split and hashed once; batches and the end read them back.
    numbered = stored(numbered_lines(rows, min_key_chars, ["__copy"]), "line-hashes")
    bounds = batch_bounds(rows.select("__doc"), batch_docs)
    edges = [None, *bounds, None]
    runs = LineRuns(fanout=fanout)
    for hi, lo in zip(reversed(edges[1:]), reversed(edges[:-1]), strict=True):
        batch = numbered.select("__doc", "line_no", "hash")
        if lo is not None:
            batch = batch.where(F.col("__doc") >= F.lit(lo))
        if hi is not None:
            batch = batch.where(F.col("__doc") < F.lit(hi))
        runs.add(batch)
    final = runs.compacted()
    dropping = final.where(F.col("n_docs") >= min_docs).select("hash", "top_doc")
    dropped = (
        numbered.join(dropping, "hash")
        .where(F.col("__doc") != F.col("top_doc"))
        .groupBy("__doc", "__copy")
        .agg(F.collect_set("line_no").alias("__gone"))
    )
    out = rows.join(dropped, ["__doc", "__copy"], "left")
    parts = split_lines(F.col("__text"))
    gone = F.coalesce(F.col("__gone"), F.array().cast("array<int>"))
    kept = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains(gone, i)), "\n")
    return out.select(
        F.when(F.col("__doc") != F.lit(NO_DOC), F.col("__doc")).alias("doc_id"),
        F.size(parts).cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_dropped"),
        kept.alias("kept_text"),
        F.sha2(kept, 256).alias("kept_sha256"),
        "row",
    )
