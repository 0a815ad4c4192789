"""Spelling variants: words one edit apart, found on a relational trie.

The trie of all words is a table of edges (node, character, depth), a node
being the hash of a prefix. A search state is (word, position, node, edits).
A word's states without edits walk its own prefixes; at every level the
frontier of those states is joined with the edges leaving its node, which
gives the states with one edit: a replaced or inserted character where an
edge leads on and the next character of the word leaves the node it leads
to (the edges carry those characters), or a deleted one. The levels are taken in rounds of doubling
width, so a word of length L is done after about log2(L) joins. A state with
one edit walks on only by exact characters, so it ends on a terminal node
exactly when the word it spells is in the vocabulary: one equality join of
the spelled words with the vocabulary finds these terminal states, which are
the neighbours. Nodes and spelled words travel as 64-bit hashes, which may
only add a dead state or a false match; every match is confirmed on whole
words, so results are exact.

Defined results:

* null text has no runs; a null doc_id is written as the empty string in
  ``<doc_id>:<run>``;
* repeated rows count each time, as every run of every row is an occurrence;
* a word with no near word has n_near 0, form null and root itself;
* forms only point to words of at least five times the count, so chains end;
* empty tables give an empty result; further input columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicspan.llm.common import stored

# Fixed values of the contract.
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DROP_EVERY = 199
MIN_CHARS = 6
MIN_COUNT = 5
FORM_RATIO = 5


def runs_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every run of letters, lower-cased A-Z, with a character dropped where the
    keyed CRC-32 says so: column ``word``."""
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(RUN), 0)
    runs = docs.select(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("__doc"),
        F.explode(found).alias("__run"),
    ).select("__doc", F.translate("__run", UPPER, LOWER).alias("__run"))
    h = F.crc32(F.concat(F.col("__doc"), F.lit(":"), F.col("__run")).cast("binary"))
    at = (h % F.length("__run")).cast("int")
    dropped = F.concat(F.substring("__run", 1, at), F.expr("substring(__run, 2 + int(__at))"))
    return runs.withColumn("__at", at).select(
        F.when(h % DROP_EVERY == 0, dropped).otherwise(F.col("__run")).alias("word")
    )


def vocabulary(runs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of words long and frequent enough."""
    counted = runs.where(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= min_count)


def joined(one: DataFrame, two: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the vocabulary: both are shuffled.

    Spark sizes a table of exploded words as if each word were one row, and a
    stored one by its compressed bytes, and would broadcast it through the driver.
    """
    return one.hint("merge").join(two.hint("merge"), on, how)


def prefix_node(word: Column, length: Column) -> Column:
    return F.xxhash64(F.substring(word, F.lit(1), length), length)


def trie_edges(words: DataFrame) -> DataFrame:
    """(depth, node, ch, next_chars, terminal): the edges of the trie of all
    words, each with the characters that leave the node it leads to, and
    whether a word ends there: the frontier looks one level ahead."""
    at = words.select("word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("depth"))
    rows = at.select(
        "depth",
        prefix_node(F.col("word"), F.col("depth")).alias("node"),
        F.substring(F.col("word"), F.col("depth") + 1, 1).alias("ch"),
        F.substring(F.col("word"), F.col("depth") + 2, 1).alias("after"),
    )
    return rows.groupBy("depth", "node", "ch").agg(
        F.array_join(F.collect_set("after"), "").alias("next_chars"),
        F.max(F.col("after") == "").alias("terminal"),
    )


def frontier_round(words: DataFrame, edges: DataFrame, lo: int, hi: int) -> DataFrame:
    """(src, spelled): hashes of a word and of a word its one-edit states at
    levels lo <= d < hi spell; only the hashes leave the task."""
    states = words.where(F.length("word") >= lo).select(
        "word", F.explode(F.sequence(F.lit(lo), F.least(F.lit(hi - 1), F.length("word")))).alias("depth")
    )
    states = states.withColumn("node", prefix_node(F.col("word"), F.col("depth")))
    head = F.substring(F.col("word"), F.lit(1), F.col("depth"))
    own = F.substring(F.col("word"), F.col("depth") + 1, 1)
    # substring(w, p) with p past the end is empty, which is what a tail needs.
    tail_from = lambda k: F.expr(f"substring(word, depth + {k})")
    src = F.xxhash64("word").alias("src")
    stepped = joined(states, edges.where((F.col("depth") >= lo) & (F.col("depth") < hi)), ["depth", "node"])
    # One level ahead: the character the word goes on with must leave the
    # node the edit led to, or, at the word's end, a word must end there.
    goes_on = lambda k: F.when(
        F.col("depth") + k > F.length("word"), F.col("terminal")
    ).otherwise(F.expr(f"instr(next_chars, substring(word, depth + {k}, 1)) > 0"))
    replaced = stepped.where((F.col("depth") < F.length("word")) & (F.col("ch") != own) & goes_on(2)).select(
        src, F.xxhash64(F.concat(head, F.col("ch"), tail_from(2))).alias("spelled")
    )
    inserted = stepped.where(goes_on(1)).select(
        src, F.xxhash64(F.concat(head, F.col("ch"), tail_from(1))).alias("spelled")
    )
    deleted = states.where(F.col("depth") < F.length("word")).select(
        src, F.xxhash64(F.concat(head, tail_from(2))).alias("spelled")
    )
    return replaced.unionByName(inserted).unionByName(deleted)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n): distinct pairs one edit apart.

    The spelled words meet the vocabulary by 64-bit hash; every pair found is
    then confirmed on the whole words (Levenshtein distance 1), so a hash
    collision can add no pair, and none is lost, as equal words hash equal.
    """
    edges = stored(trie_edges(words), "trie-edges")
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    spelled = None
    lo, width = 0, 1
    while lo <= longest:
        part = frontier_round(words, edges, lo, lo + width)
        spelled = part if spelled is None else spelled.unionByName(part)
        lo, width = lo + width, width * 2
    hashed = words.select(F.xxhash64("word").alias("h"), "word", "n")
    if spelled is None:
        return words.select("word", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    terminal = hashed.select(F.col("h").alias("spelled"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    found = joined(spelled, terminal, "spelled").select("src", "near", "near_n").distinct()
    sources = hashed.select(F.col("h").alias("src"), "word")
    return (
        joined(found, sources, "src")
        .where(F.levenshtein("word", "near") == 1)
        .select("word", "near", "near_n")
        .distinct()
    )


def spelling_variants(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_chars: int = MIN_CHARS,
    min_count: int = MIN_COUNT,
    ratio: int = FORM_RATIO,
) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n."""
    words = stored(vocabulary(runs_of(docs, doc_id, text), min_chars, min_count), "spelling-words")
    pairs = stored(near_pairs(words), "spelling-pairs")
    best_n = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.max("near_n").alias("top_n"))
    best = (
        joined(pairs, best_n, "word")
        .where(F.col("near_n") == F.col("top_n"))
        .groupBy("word", "n_near", "top_n")
        .agg(F.min("near").alias("top"))
    )
    judged = joined(words, best, "word", "left").select(
        "word",
        "n",
        F.coalesce(F.col("n_near"), F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("top_n") >= ratio * F.col("n"), F.col("top")).alias("form"),
        F.when(F.col("top_n") >= ratio * F.col("n"), F.col("top_n")).cast("long").alias("form_n"),
    )
    judged = stored(judged, "spelling-forms")
    return with_roots(judged).select("word", "form", "root", F.col("n").cast("long").alias("n"), "n_near", "form_n")


def with_roots(judged: DataFrame) -> DataFrame:
    """Follow forms to their end by pointer doubling: each round jumps twice as far."""
    links = judged.select("word", F.coalesce("form", "word").alias("root"))
    while True:
        hop = joined(links.alias("a"), links.alias("b"), F.col("a.root") == F.col("b.word"), "left")
        nxt = hop.select(F.col("a.word").alias("word"), F.coalesce(F.col("b.root"), F.col("a.root")).alias("root"))
        nxt = stored(nxt, "spelling-roots")
        moved = joined(nxt.alias("n"), links.alias("l"), "word").where(F.col("n.root") != F.col("l.root")).limit(1).count()
        links = nxt
        if moved == 0:
            break
    return joined(judged, links, "word")
