"""Quality classifier: perplexity under a modified Kneser-Ney model of trusted text.

The model predicts words from the word before. Its tables hold every pair and
every word of the trusted texts, grow with them, and are joined with the pairs of
the documents; see ``word_bits``. A word that no trusted text has is spelled by a
model of characters: classes of them, from the ``ORDER - 1`` before, times the
share of each character in its class. That model has ``LETTERS ** ORDER`` entries
at most, 21 MB, and one per code point, whatever the corpus; tasks share it.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicspan.llm.common import WORD, stored, texts_of
from topicspan.operators.lookup import COMMON_PARTS, frequent_keys
from topicspan.session import scratch_path, settled

LETTERS = 48
ORDER = 4
CODES = 0x110000  # code points of Unicode
# Characters of prior weight: the perplexity of a short text leans to its language's median.
PRIOR = 100
# A text may lie so many distances above the median, where the distance is that
# from the median to the upper quantile of the trusted texts of the same language,
# and no less than ``LEAST`` bits a character.
HIGH_QUANTILE = 0.95
FENCE = 2.0
LEAST = 0.1
SCALE = 1000  # quantiles are taken over thousandths of a bit

# Pairs are counted, and words and pairs of texts looked up, in so many parts, one after the other.
COUNT_PARTS = 3
PARTS = 10

# Characters with a class of their own, by class.
_OWN = {1: " \t\n\v\f\r", 30: ".", 31: ",", 32: "!", 33: "?", 34: "'\"", 35: "-", 36: ":;", 37: "()[]{}", 38: "#*$%&|<>"}


def _classes() -> np.ndarray:
    """Class of each of the first 65,536 characters; 0 is the start of a text."""
    out = np.full(1 << 16, LETTERS - 1, dtype=np.uint8)
    for code in range(1 << 16):
        ch = chr(code)
        kind = unicodedata.category(ch)
        if "a" <= ch <= "z":
            out[code] = 2 + code - ord("a")
        elif kind == "Lu":
            out[code] = 28
        elif kind == "Nd":
            out[code] = 29
        elif kind[0] == "L" or kind[0] == "M":
            out[code] = 40 + code % 7
        elif code < 128 and kind[0] in "PS":
            out[code] = 39
    for number, chars in _OWN.items():
        for ch in chars:
            out[ord(ch)] = number
    return out


_CLASS: list[np.ndarray] = []
_word = re.compile(WORD)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def grams(text: str) -> np.ndarray:
    """The n-gram that ends at each character of ``text``, as a number."""
    if not _CLASS:
        _CLASS.append(_classes())
    codes = _codes(text)
    kinds = np.zeros(len(codes) + ORDER - 1, dtype=np.int64)
    kinds[ORDER - 1 :] = np.where(codes < 1 << 16, _CLASS[0][np.minimum(codes, (1 << 16) - 1)], LETTERS - 1)
    out = np.zeros(len(codes), dtype=np.int64)
    for i in range(ORDER):
        out = out * LETTERS + kinds[i : i + len(codes)]
    return out


def gram_counts(texts: DataFrame, text: str) -> DataFrame:
    """(gram, n): counts over all ``texts``, added up within each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**ORDER, dtype=np.int64)
        for batch in batches:
            for t in texts_of(batch, text):
                if len(t) > 100_000:
                    total += np.bincount(grams(t), minlength=len(total))
                else:
                    found, n = np.unique(grams(t), return_counts=True)
                    total[found] += n
        seen = np.flatnonzero(total)
        for at in range(0, len(seen), 100_000):
            part = seen[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["gram", "n"])

    return texts.select(text).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Discounts of n-grams seen once, twice and more often, from counts of counts."""
    of = counts.agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(1, 5)]).first()
    return _discounts_of([of[f"n{i}"] for i in range(1, 5)])


def _discounts_of(seen: Sequence[int]) -> tuple[float, float, float]:
    n1, n2, n3, n4 = seen
    if not (n1 and n2):
        return 0.5, 1.0, 1.5  # too few n-grams to tell
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.0), i + 1.0) for i, d in enumerate(found))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(width, gram, p, rest): the interpolated model, one row per seen n-gram.

    ``p`` is the probability of the last character after the others. ``rest`` is
    not null in rows of contexts (gram of ``width`` characters): the weight that
    is left to the shorter context. Lower orders count the different characters
    that come before.
    """
    tables = {ORDER: counts}
    for width in range(ORDER - 1, 0, -1):
        longer = tables[width + 1]
        tables[width] = stored(
            longer.groupBy((F.col("gram") % LETTERS**width).alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"kn-{width}"
        )
    lower, out = None, []
    for width in range(1, ORDER + 1):
        d1, d2, d3 = discounts(tables[width])
        off = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        rows = tables[width].select(
            "gram",
            F.floor(F.col("gram") / LETTERS).alias("context"),
            (F.col("gram") % LETTERS ** (width - 1)).alias("suffix"),
            "n",
            off.alias("off"),
        )
        contexts = rows.groupBy("context").agg(
            F.sum("n").alias("all"), (F.sum("off") / F.sum("n")).alias("rest")
        )
        joined = rows.join(contexts, "context")
        if lower is None:
            joined = joined.withColumn("below", F.lit(1.0 / LETTERS))
        else:
            joined = joined.join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below")), "suffix")
        p = (F.col("n") - F.col("off")) / F.col("all") + F.col("rest") * F.col("below")
        lower = stored(joined.select("gram", p.alias("p")), f"kn-p{width}")
        nothing = F.lit(None).cast("double")
        out.append(lower.select(F.lit(width).alias("width"), "gram", "p", nothing.alias("rest")))
        out.append(
            contexts.select(F.lit(width - 1).alias("width"), F.col("context").alias("gram"), nothing.alias("p"), "rest")
        )
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def bits_table(model: DataFrame) -> np.ndarray:
    """-log2 of the probability of every n-gram, seen or not."""
    rows = model.toPandas()  # at most 2 * LETTERS ** ORDER rows, whatever the corpus
    p = np.full(1, 1.0 / LETTERS)
    for width in range(1, ORDER + 1):
        rest = np.ones(LETTERS ** (width - 1))
        of = rows[(rows["width"] == width - 1) & rows["rest"].notna()]
        rest[of["gram"].to_numpy()] = of["rest"].to_numpy()
        below = np.tile(p, LETTERS) if width > 1 else np.full(LETTERS, p[0])
        p = np.repeat(rest, LETTERS) * below
        seen = rows[(rows["width"] == width) & rows["p"].notna()]
        p[seen["gram"].to_numpy()] = seen["p"].to_numpy()
    return (-np.log2(np.maximum(p, 1e-12))).astype(np.float32)


def letter_counts(texts: DataFrame, text: str) -> DataFrame:
    """(letter, n): how often each code point occurs in ``texts``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CODES, dtype=np.int64)
        for batch in batches:
            for t in texts_of(batch, text):
                found, n = np.unique(_codes(t), return_counts=True)
                total[found] += n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["letter", "n"])

    return texts.select(text).mapInArrow(count, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n"))


def letter_bits(counts: DataFrame) -> np.ndarray:
    """-log2 of the probability of each code point within its class; unseen ones share one count."""
    rows = counts.toPandas()  # at most one row per code point of Unicode
    n = np.zeros(CODES)
    n[rows["letter"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy()
    kinds = np.full(CODES, LETTERS - 1)
    kinds[: 1 << 16] = _classes()
    sizes = np.bincount(kinds, minlength=LETTERS)
    totals = np.bincount(kinds, weights=n, minlength=LETTERS)
    return (-np.log2((n + 1 / sizes[kinds]) / (totals[kinds] + 1))).astype(np.float32)


def spelling(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each n-gram of classes, and of each code point in its class, by the characters of ``texts``."""
    bits = bits_table(kneser_ney(stored(gram_counts(texts, "text"), "kn-counts")))
    return bits, letter_bits(letter_counts(texts, "text"))


def spell(words: list[str], classes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """What it takes to spell each word, behind spaces and with the space that ends it."""
    gap = " " * (ORDER - 1)
    line = gap + gap.join(words) + " "
    at = _codes(line)
    upto = np.concatenate(([0.0], np.cumsum(classes[grams(line)].astype(np.float64) + letters[at])))
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.cumsum(sizes + len(gap)) - sizes
    return upto[starts + sizes + 1] - upto[starts]


def _stirred(x: np.ndarray) -> np.ndarray:
    """The final steps of splitmix64: every bit depends on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_MARK = _stirred(np.array([0xA0761D6478BD642F], dtype=np.uint64))[0]  # the empty word around a text
# The first bytes of eight, as numbers.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_LONG = 64  # bytes of a word that is not hashed beside others


def word_hashes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(index of its text, 64-bit hash) of every word, in order."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    raw = b" ".join([b"", *parts, bytes(8)])
    data = np.frombuffer(raw, dtype=np.uint8)[: len(raw) - 8]
    inside = (data - np.uint8(9) > 4) & (data != 32)
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    # Eight bytes from each place on.
    words = np.ndarray((len(data),), dtype="<u8", buffer=raw, strides=(1,))
    left = ends - starts
    hashes = left.astype(np.uint64)
    rows = np.flatnonzero(left <= _LONG)
    at, left = starts[rows], left[rows]
    while len(rows):
        hashes[rows] = _stirred(hashes[rows] ^ (words[at] & _FIRST[np.minimum(left, 8)]))
        more = np.flatnonzero(left > 8)
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(ends - starts > _LONG):
        digest = hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8).digest()
        hashes[i] = int.from_bytes(digest, "little")
    return np.searchsorted(np.cumsum(sizes + 1), starts - 1, side="right"), hashes


def word_keys(hashes: np.ndarray, halves: np.ndarray) -> np.ndarray:
    """The word in the model of its half, which is the lowest bit."""
    return (hashes & ~np.uint64(1)) | halves.astype(np.uint64)


def text_pairs(texts: Sequence[str], halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of its text, before, word) of every pair of words, as ``word_keys``.

    A text begins behind, and ends with, an empty word, so its words and one empty word are
    what comes before, and what comes next.
    """
    at, hashes = word_hashes(texts)
    doc = np.repeat(np.arange(len(texts)), np.bincount(at, minlength=len(texts)) + 1)
    before, word = np.full(len(doc), _MARK), np.full(len(doc), _MARK)
    place = np.arange(len(at)) + at
    before[place + 1], word[place] = hashes, hashes
    return doc, word_keys(before, halves[doc]), word_keys(word, halves[doc])


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return before ^ ((word << np.uint64(1)) | (word >> np.uint64(63)))


def _in_part(keys: np.ndarray, part: int, parts: int) -> np.ndarray:
    return keys % np.uint64(parts) == part


def _halves(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("half").to_numpy(zero_copy_only=False)


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def trained_pairs(trusted: DataFrame, part: int, parts: int) -> DataFrame:
    """(before, word, n) of the pairs in one of ``parts``; a text's pairs are in the model of the other half."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, before, word = text_pairs(texts_of(batch, "text"), 1 - _halves(batch))
            mine = np.flatnonzero(_in_part(pair_keys(before, word), part, parts))
            before, word = before[mine], word[mine]
            _, first, n = np.unique(pair_keys(before, word), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [_longs(before[first]), _longs(word[first]), pa.array(n)], ["before", "word", "n"]
            )

    rows = trusted.select("half", "text").mapInArrow(count, "before long, word long, n long")
    return rows.groupBy("before", "word").agg(F.sum("n").alias("n"))


def spelled_words(trusted: DataFrame, shared: Broadcast) -> DataFrame:
    """(key, bits0) of the words of the trusted texts, and of the empty word."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            halves = 1 - _halves(batch)
            for half in np.unique(halves):
                texts = [t for t, h in zip(texts_of(batch, "text"), halves, strict=True) if h == half]
                words = sorted({w for t in texts for w in _word.findall(t)})
                hashes = np.append(word_hashes([" ".join(words)])[1], _MARK)
                keys = word_keys(hashes, np.full(len(hashes), half))
                bits0 = spell([*words, ""], *shared.value)
                yield pa.RecordBatch.from_arrays([_longs(keys), pa.array(bits0)], ["key", "bits0"])

    return trusted.select("half", "text").mapInArrow(find, "key long, bits0 double").groupBy("key").agg(F.max("bits0").alias("bits0"))


def known_words(trusted: DataFrame, shared: Broadcast) -> tuple[DataFrame, dict, dict, Sequence[float]]:
    """The model's words, totals of each half, bits that an unknown word takes more, and discounts of pairs.

    Words are (key, all, rest, share, bits1, delta): a word as context, its bits behind an
    unknown context, and what knowing it as word and as context adds to the bits of an unknown one.
    """
    sums = [f"n{i}" for i in range(1, 6)]
    parts, path = [], scratch_path(trusted.sparkSession, "kn-words-parts")
    for part in range(COUNT_PARTS):
        counts = trained_pairs(trusted, part, COUNT_PARTS)
        each = [F.when(F.col("n") == i if i < 5 else F.col("n") > 4, 1).otherwise(0) for i in range(1, 6)]
        as_before = F.struct(F.col("before").alias("key"), F.col("n").alias("all"), *[e.alias(c) for e, c in zip(each, sums, strict=True)], F.lit(0).alias("n"))
        as_word = F.struct(F.col("word").alias("key"), F.lit(0).cast("long").alias("all"), *[F.lit(0).alias(c) for c in sums], F.lit(1).alias("n"))
        rows = counts.select(F.explode(F.array(as_before, as_word)).alias("w")).select("w.*")
        parts.append(settled(rows.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("all", *sums, "n")]), "kn-words-part", f"{path}/{part}"))
    spelled = settled(spelled_words(trusted, shared), "kn-spelled", f"{path}/spelled")
    whole = parts[0]
    for other in parts[1:]:
        whole = whole.unionByName(other)
    whole = whole.unionByName(spelled, allowMissingColumns=True)
    whole = whole.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("all", *sums, "n")], F.max("bits0").alias("bits0"))
    words = settled(whole.withColumn("half", F.col("key").bitwiseAND(F.lit(1))), "kn-words")
    trusted.sparkSession.range(0).write.mode("overwrite").parquet(path)  # the parts are not read again

    off_pairs = _discounts_of([words.agg(F.sum(f"n{i}")).first()[0] or 0 for i in range(1, 5)])
    words = _discounted(words)
    totals = {
        r["half"]: r.asDict()
        for r in words.groupBy("half").agg(F.sum("n").alias("all"), F.sum("off").alias("freed"), F.sum("all").alias("size")).collect()
    }
    more = {h: -float(np.log2(max(totals[h]["freed"] / totals[h]["all"], 1e-9))) if h in totals else 0.0 for h in (0, 1)}

    def of_half(name: str) -> Column:
        of = {h: totals[h][name] if h in totals else None for h in (0, 1)}
        return F.when(F.col("half") == 1, F.lit(of[1])).otherwise(F.lit(of[0])).cast("double")

    d1, d2, d3 = off_pairs
    freed = F.col("n1") * d1 + F.col("n2") * d2 + (F.col("n3") + F.col("n4") + F.col("n5")) * d3
    unknown = F.col("bits0") + F.when(F.col("half") == 1, more[1]).otherwise(more[0])
    table = words.select(
        "key",
        "all",
        (freed / F.col("all")).alias("rest"),
        (F.col("all") / of_half("size")).alias("share"),
        _mixed((F.col("n") - F.col("off")) / of_half("all"), of_half("freed") / of_half("all"), F.col("bits0")).alias("bits1"),
        unknown.alias("unknown"),
    ).select("*", (F.col("bits1") + _mixed(F.lit(0.0), F.col("rest"), F.lit(0.0)) - F.col("unknown")).alias("delta"))
    return table.drop("unknown"), totals, more, off_pairs


def known_pairs(trusted: DataFrame, words: DataFrame, totals: dict, off: Sequence[float], part: int) -> DataFrame:
    """(key, weight, delta, joint) of the pairs in a part: what knowing the pair adds to the bits of
    an unknown one of the same words, and its share of all pairs of the model."""
    turned = F.shiftleft("word", 1).bitwiseOR(F.shiftrightunsigned("word", 63))
    key = F.col("before").bitwiseXOR(turned).alias("key")
    rows = trained_pairs(trusted, part, PARTS).select(key, "before", "word", "n")
    # Of words that most rows have, the table is shared.
    common = frequent_keys(words, "all", COMMON_PARTS)
    for name, columns in (("word", ["bits1"]), ("before", ["all", "rest"])):
        hot = common.select(F.col("key").alias(name), F.struct(*columns).alias("hot"))
        cold = words.select(F.col("key").alias("__key"), F.struct(*columns).alias("cold"))
        spread = F.when(F.col("hot").isNull(), F.col(name)).otherwise(F.col("key"))
        rows = rows.join(F.broadcast(hot), name, "left").withColumn("__key", spread).join(cold, "__key", "left")
        keep = [c for c in rows.columns if c not in ("__key", "hot", "cold", "word")]
        rows = rows.select(*keep, *[F.coalesce(f"hot.{c}", f"cold.{c}").alias(c) for c in columns])
    n = F.col("n")
    freed = F.when(n == 1, off[0]).when(n == 2, off[1]).otherwise(off[2])
    unseen = F.col("bits1") + _mixed(F.lit(0.0), F.col("rest"), F.lit(0.0))
    bits = _mixed((n - freed) / F.col("all"), F.col("rest"), F.col("bits1"))
    size = {h: totals[h]["size"] if h in totals else None for h in (0, 1)}
    sizes = F.when(F.col("before").bitwiseAND(F.lit(1)) == 1, F.lit(size[1])).otherwise(F.lit(size[0]))
    return rows.select(
        "key",
        n.alias("weight"),
        (bits - unseen).alias("delta"),
        (F.col("all") / sizes * F.pow(F.lit(2.0), -bits)).alias("joint"),
    )


def _sorted_values(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys, sorted, and values of a table of bounded size."""
    found = rows.toArrow()
    keys, values = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order]


def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The value of each key; NaN without one."""
    known, values = table
    if not len(known):
        return np.full(len(keys), np.nan)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], np.nan)


def _counted(doc: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of its first, number) of each different key of each text."""
    order = np.lexsort((keys, doc))
    d, k = doc[order], keys[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order)))


def known_bits(texts: DataFrame, model: DataFrame, common: Broadcast, part: int) -> DataFrame:
    """(id, bits): what the words and pairs of a part that the model knows add for each text.

    Keys that most rows have are looked up in ``common``, where the text is; the other rows meet the model.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, before, word = text_pairs(texts_of(batch, "text"), _halves(batch))
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            keys = np.concatenate((before, pair_keys(before, word)))
            mine = np.flatnonzero(_in_part(keys, part, PARTS))
            keys, doc = keys[mine], np.concatenate((doc, doc))[mine]
            first, n = _counted(doc, keys)
            keys, doc = keys[first], doc[first]
            delta = _find(common.value, keys)
            rest = np.flatnonzero(np.isnan(delta))
            sums = np.bincount(doc, np.nan_to_num(delta) * n, minlength=len(ids))
            # A text's sum has its id as key, so that these rows are spread, and no count.
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((ids, ids[doc[rest]]))),
                    pa.array(np.concatenate((ids, keys[rest].view(np.int64)))),
                    pa.array(np.concatenate((np.zeros(len(ids), dtype=np.int64), n[rest]))),
                    pa.array(np.concatenate((sums, np.zeros(len(rest))))),
                ],
                ["id", "key", "n", "bits"],
            )

    rows = texts.select("id", "half", "text").mapInArrow(find, "id long, key long, n long, bits double")
    found = rows.join(model.select("key", "delta"), "key", "left").where("n = 0 OR delta IS NOT NULL")
    own = F.when(F.col("n") > 0, F.col("n") * F.col("delta")).otherwise(F.col("bits"))
    return found.groupBy("id").agg(F.sum(own).alias("bits"))


def unknown_bits(texts: DataFrame, shared: Broadcast, top: Broadcast, more: dict) -> DataFrame:
    """(id, bits, surplus, rows): bits of each text if no word and no pair were known, and its repeated pairs.

    ``top`` has all pairs, contexts and words that are frequent enough for a
    pair to be expected more than once in the longest text: no other changes a surplus.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, contexts, known = top.value
        for batch in batches:
            texts, halves = texts_of(batch, "text"), _halves(batch)
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            found = [_word.findall(t) for t in texts]
            listed = pa.array([w for ws in found for w in ws], pa.string()).dictionary_encode()
            bits_of = spell([*listed.dictionary.to_pylist(), ""], *shared.value)
            doc, before, word = text_pairs(texts, halves)
            own = np.full(len(doc), len(bits_of) - 1)  # the word of each pair; the last is empty
            ends = np.append(np.flatnonzero(np.diff(doc)), len(doc) - 1)[: len(texts)]
            inner = np.ones(len(doc), dtype=bool)
            inner[ends] = False
            own[inner] = listed.indices.to_numpy(zero_copy_only=False)
            bits0 = bits_of[own] + np.array([more[0], more[1]])[halves[doc]]
            n_pairs = np.bincount(doc, minlength=len(ids))
            keys = pair_keys(before, word)
            first, n = _counted(doc, keys)
            first, n = first[n > 1], n[n > 1]
            p_word = _find(known, word[first])
            p_word = np.where(np.isnan(p_word), 2.0 ** -bits0[first], p_word)
            joint = _find(pairs, keys[first])
            joint = np.where(np.isnan(joint), np.nan_to_num(_find(contexts, before[first])) * p_word, joint)
            surplus = n * np.log2(np.maximum(n / np.maximum(n_pairs[doc[first]] * joint, 1.0), 1.0))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids),
                    pa.array(np.bincount(doc, bits0, minlength=len(ids))),
                    pa.array(np.bincount(doc[first], surplus, minlength=len(ids)).astype(np.float64)),
                    pa.array(np.ones(len(ids), dtype=np.int64)),
                ],
                ["id", "bits", "surplus", "rows"],
            )

    rows = texts.select("id", "half", "text").mapInArrow(find, "id long, bits double, surplus double, rows long")
    return rows.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("bits", "surplus", "rows")])


def _discounted(counts: DataFrame) -> DataFrame:
    d1, d2, d3 = discounts(counts)
    return counts.withColumn("off", F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3))


def word_bits(texts: DataFrame, trusted: DataFrame, longest: int) -> DataFrame:
    """(id, bits, surplus): sums over the words of each text under a Kneser-Ney model of word pairs.

    ``texts`` and ``trusted`` have half and text, and ``texts`` an id of the text. Trusted
    texts are dealt into halves by hash, and the model of one half scores
    the texts of the other, trusted or not: no text, nor a copy of it, is known to
    the model that scores it. Tables of pairs, contexts and words grow with the
    text and are joined, as 64-bit hashes. A word that was never seen is spelled.
    ``surplus`` are the bits by which pairs repeat: ``n * log2(n / expected)`` for
    each pair that a text has more often than the model expects in its length, and
    than once. ``longest`` bounds the number of pairs of a text.

    The bits of a text are those of one that the model knows nothing of, and what each
    known word and pair adds. The latter is joined part by part: the texts are read ``PARTS``
    times, and a part's rows are off the disk before the next are made.
    """
    spark = texts.sparkSession
    context = spark.sparkContext
    shared = context.broadcast(spelling(trusted))
    words, totals, more, off = known_words(trusted, shared)
    path, sums, pairs = scratch_path(spark, "kn-model"), [], []
    for part in range(PARTS if totals else 0):
        unsigned = F.pmod(F.pmod(F.col("key"), F.lit(PARTS)) + F.when(F.col("key") < 0, (1 << 64) % PARTS).otherwise(0), F.lit(PARTS))
        own = words.where(unsigned == part).select("key", F.col("all").alias("weight"), "delta", F.lit(0.0).alias("joint"))
        model = settled(own.unionByName(known_pairs(trusted, words, totals, off, part)), "kn-model", path)
        common = context.broadcast(_sorted_values(frequent_keys(model, "weight", COMMON_PARTS).select("key", "delta")))
        pairs.append(_sorted_values(model.where(F.col("joint") * longest > 1).select("key", "joint")))
        sums.append(settled(known_bits(texts, model, common, part), "kn-part-bits"))
        common.destroy()
    spark.range(0).write.mode("overwrite").parquet(path)  # the last part is not read again
    keys, joint = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0) for i in (0, 1))
    order = np.argsort(keys)
    unseen = F.col("share") * F.greatest(F.col("rest"), F.lit(1e-9))
    likely = F.pow(F.lit(2.0), -F.col("bits1"))
    tops = [
        _sorted_values(words.select("key", value.alias("value")).where(F.col("value") * longest > 1))
        for value in (unseen, likely)
    ]
    top = context.broadcast(((keys[order], joint[order]), *tops))
    whole = settled(unknown_bits(texts, shared, top, more), "kn-unknown-bits")
    for rows in sums:
        whole = whole.unionByName(rows, allowMissingColumns=True)
    # Copies of a text were added up.
    whole = whole.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("bits", "surplus", "rows")])
    return whole.select("id", *[(F.col(c) / F.col("rows")).alias(c) for c in ("bits", "surplus")])


def _mixed(p: Column, rest: Column, below: Column) -> Column:
    """Bits of ``p + rest * 2 ** -below``, where that may be too small for a double."""
    far = below - F.log2(F.greatest(rest, F.lit(1e-9)))
    return F.when(p > 0, -F.log2(p + F.pow(F.lit(2.0), -far))).otherwise(far)


def with_trust(rows: DataFrame, labels: DataFrame, doc: str, id_column: str) -> DataFrame:
    """``rows`` with ``trusted``: is the document labelled as good quality, and not as toxic?

    Both sides are sorted by ``doc`` whatever their sizes, so that the plan is the same
    for any number of labels. Rows without one are spread by ``id_column``.
    """
    fine = "quality = 1 AND doc_id IS NOT NULL"
    if "toxic" in labels.columns:
        fine += " AND coalesce(toxic, 0) <> 1"
    good = labels.where(fine).select(F.col("doc_id").cast("string").alias("__id")).distinct()
    own = F.coalesce(F.col(doc).cast("string"), F.concat(F.lit("?"), F.col(id_column).cast("string")))
    marked = rows.withColumn("__id", own).join(good.withColumn("__good", F.lit(True)).hint("merge"), "__id", "left")
    return marked.withColumn("trusted", F.col("__good").isNotNull()).drop("__id", "__good")


def language_fences(rows: DataFrame, rate: str) -> DataFrame:
    """(lang, typical, fence) of ``rate``, in thousandths of a bit, from quantiles of each language.

    ``rows`` has (lang, rate, n_symbols) of trusted texts. The rates of a language take few
    values, so their counts add up to exact quantiles. The upper quantile is one
    of rates that lean to the median, as the rates do that are judged.
    """

    def quantile(values: DataFrame, q: float, name: str) -> DataFrame:
        counts = values.groupBy("lang", "value").agg(F.count(F.lit(1)).alias("n"))
        every = Window.partitionBy("lang")
        ranked = counts.withColumn("upto", F.sum("n").over(every.orderBy("value"))).withColumn(
            "all", F.sum("n").over(every)
        )
        return ranked.groupBy("lang").agg(F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("value"))).alias(name))

    typical = quantile(rows.select("lang", F.col(rate).alias("value")), 0.5, "typical")
    known = rows.join(typical.withColumnRenamed("lang", "__l"), F.col("lang").eqNullSafe(F.col("__l")))
    high = quantile(
        known.select("lang", F.floor(leaning(F.col(rate))).alias("value")), HIGH_QUANTILE, "high"
    ).withColumnRenamed("lang", "__l")
    spread = F.greatest(F.col("high") - F.col("typical"), F.lit(int(LEAST * SCALE)))
    return typical.join(high, F.col("lang").eqNullSafe(F.col("__l"))).select(
        "lang", "typical", (F.col("typical") + F.ceil(FENCE * spread)).alias("fence")
    )


def leaning(rate: Column) -> Column:
    """A rate with ``PRIOR`` characters of ``typical`` added."""
    return (rate * F.col("n_symbols") + PRIOR * F.col("typical")) / (F.col("n_symbols") + PRIOR)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: perplexity, fence, kept, and ``row``, a struct of
    the columns to ``keep`` (all by default).

    ``labels`` has (doc_id, quality) and may have toxic; texts of quality 1 that are
    not toxic are trusted, and all of them are counted. ``perplexity`` is per
    character, ``fence`` the highest that the trusted texts of the language let
    pass; the surplus of repeated pairs has a fence of its own. Empty and null texts
    have none and are not kept. A null language is one of its own. Without trusted
    texts every character is equally likely, and all texts with characters are kept.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row")
    texts = docs.select(
        row,
        F.col(f"`{lang}`").alias("lang"),
        F.col(f"`{text}`").alias("text"),
        F.col(f"`{id_column}`").alias("doc"),
        F.xxhash64(F.col(f"`{text}`")).alias("id"),
        F.pmod(F.xxhash64(F.col(f"`{text}`")), F.lit(2)).cast("int").alias("half"),
        F.coalesce(F.length(F.col(f"`{text}`")), F.lit(0)).cast("long").alias("n_symbols"),
    )
    filled = texts.where("n_symbols > 0")
    trusted = settled(
        with_trust(filled.select("doc", "id", "half", "text"), labels, "doc", "id").where("trusted").select("half", "text"),
        "kn-trusted",
    )
    longest = (texts.agg(F.max("n_symbols")).first()[0] or 0) // 2 + 2
    bits = settled(word_bits(filled, trusted, longest), "kn-bits")
    base = with_trust(texts.select("row", "lang", "doc", "id", "n_symbols"), labels, "doc", "id")
    rows = settled(base.join(bits, "id", "left").select("row", "lang", "n_symbols", "trusted", "bits", "surplus"), "kn-scored")
    some = F.col("n_symbols") > 0
    rated = rows.select("*", *[F.floor(F.col(c) * SCALE / F.col("n_symbols")).alias(f"{c}_rate") for c in ("bits", "surplus")])
    good = rated.where(F.col("trusted") & some)
    # A language without trusted texts is judged as all trusted texts together.
    judged = rated
    for name in ("bits", "surplus"):
        values = good.select("lang", "n_symbols", f"{name}_rate")
        own = stored(language_fences(values, f"{name}_rate"), f"kn-{name}-fences")
        every = language_fences(values.withColumn("lang", F.lit("")), f"{name}_rate").first()
        typical, fence = (every["typical"], every["fence"]) if every else (None, None)
        own = own.select(F.col("lang").alias("__lang"), F.col("typical").alias("__typical"), F.col("fence").alias("__fence"))
        judged = (
            judged.join(own, F.col("lang").eqNullSafe(F.col("__lang")), "left")
            .withColumn("typical", F.coalesce("__typical", F.lit(typical).cast("long")))
            .withColumn(f"{name}_fence", F.coalesce("__fence", F.lit(fence).cast("long")))
            .withColumn(f"{name}_fine", F.coalesce(leaning(F.col(f"{name}_rate")) <= F.col(f"{name}_fence"), F.lit(True)))
            .drop("__lang", "__typical", "__fence", "typical")
        )
    return judged.select(
        "row",
        F.when(some, F.pow(F.lit(2.0), F.col("bits") / F.col("n_symbols"))).alias("perplexity"),
        F.pow(F.lit(2.0), F.col("bits_fence") / SCALE).alias("fence"),
        (some & F.col("bits_fine") & F.col("surplus_fine")).alias("kept"),
    )


def good_documents(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their columns.

    Rows of the same text and language are all kept, or none.
    """
    marked = docs.select(
        F.col(f"`{id_column}`").alias("doc"),
        F.col(f"`{text}`").alias("text"),
        F.col(f"`{lang}`").alias("lang"),
        F.xxhash64(F.col(f"`{text}`")).alias("id"),
    )
    judged = classify(marked, labels, "doc", "text", "lang", keep=["id", "lang"])
    good = judged.where("kept").select("row.*").distinct().withColumnRenamed("lang", "__lang")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.xxhash64(F.col(f"`{text}`")).alias("__id"),
        F.col(f"`{lang}`").alias("__own"),
    )
    same = (F.col("__id") == F.col("id")) & F.col("__own").eqNullSafe(F.col("__lang"))
    return rows.join(good, same, "left_semi").select("row.*")
