"""Best-fit packing of documents into sequences of bounded length.

The plan needs only how many pieces there are of each length, so it is as large
for any number of documents. Combinations that fill a sequence exactly come
first: for every length, longest first, the gap is looked up as one length, as a
sum of two and as a sum of three. What is left goes where it fits best.
Pieces, range-sorted by length, then find their slot by their position.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField

from topicspan.llm.common import running_sums, stored, texts_of, with_columns_of

LENGTH = 4096
END = 1  # the id that closes every document
REMEMBERED = 1_000_000  # words whose ids a worker keeps; when full, it starts anew


class WordEncoder:
    """Ids of whole texts, word by word.

    White space only separates in this vocabulary: neither its normaliser nor
    its splitting nor a merge crosses it. So a text's ids are those of its words.
    """

    def __init__(self, tokenizer_file: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        # For words in which normaliser and splitter would find nothing to do: many in one text.
        self.plain = Tokenizer.from_file(tokenizer_file)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.last = np.zeros(self.plain.get_vocab_size(), dtype=bool)  # ids that end a word
        self.last[[i for token, i in self.plain.get_vocab().items() if token.endswith("</w>")]] = True
        self.seen: dict[str, bytes] = {}

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text.

        Different words are found by Arrow, so each is looked up once for all ``texts``.
        """
        cut = pc.ascii_split_whitespace(pa.array([_parted(t.encode()) for t in texts], pa.large_string()))
        places = cut.flatten().dictionary_encode()
        words, places = places.dictionary.to_numpy(zero_copy_only=False).tolist(), places.indices.to_numpy()
        found = list(map(self.seen.get, words))
        new = [w for w, known in zip(words, found, strict=True) if known is None]
        if len(self.seen) + len(new) > REMEMBERED:
            self.seen, new = {}, words
        self.learn(new)
        found = [self.seen[w] if known is None else known for w, known in zip(words, found, strict=True)]
        ids = np.frombuffer(b"".join(found), dtype="<u4")
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        starts = np.cumsum(sizes) - sizes
        bounds = cut.offsets.to_numpy()
        return [_gathered(ids, starts, sizes, places[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]

    def learn(self, words: list[str]) -> None:
        plain, others = [], []
        for word in words:
            (plain if _is_plain(word) else others).append(word)
        for at in range(0, len(others), 20_000):
            some = others[at : at + 20_000]
            encoded = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            for word, e in zip(some, encoded, strict=True):
                self.seen[word] = array("I", e.ids).tobytes()
        groups = [plain[at : at + 500] for at in range(0, len(plain), 500)]
        for at in range(0, len(groups), 40):
            some = groups[at : at + 40]
            encoded = self.plain.encode_batch_fast([" ".join(g) for g in some], add_special_tokens=False)
            for group, e in zip(some, encoded, strict=True):
                ids = np.array(e.ids, dtype="<u4")
                upto = [0, *(4 * np.flatnonzero(self.last[ids]) + 4).tolist()]
                ids = ids.tobytes()
                for word, a, b in zip(group, upto, upto[1:], strict=False):
                    self.seen[word] = ids[a:b]


def _gathered(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> bytes:
    """The ids of the words at ``places``, one after the other."""
    n = sizes[places]
    before = np.cumsum(n) - n
    return ids[np.repeat(starts[places] - before, n) + np.arange(n.sum())].tobytes()


# A stop or comma first: the search skips all else.
_END_OF_WORD = re.compile(rb"[.,](?<=[a-z0-9].)[.,]*(?=[\t-\r ]|\Z)")


def _parted(data: bytes) -> bytes:
    """Text with a space between the parts that are encoded by themselves: words, and stops and commas behind them.

    The tokenizer lower-cases, and cuts between a letter or digit and what is
    neither; doing so first leaves fewer different parts. Special tokens count
    as written, so texts that may hold one keep their case.
    """
    if b"<|" not in data:
        data = data.lower()
    return _END_OF_WORD.sub(rb" \g<0>", data)


def _is_plain(word: str) -> bool:
    """Latin letters in lower case and normal form only."""
    if word.isascii():
        return word.isalpha() and word.islower()
    return word.isalpha() and word == word.lower() and max(word) < "\u0250" and unicodedata.is_normalized("NFC", word)


_ENCODERS: dict[str, WordEncoder] = {}


def pieces_of(docs: DataFrame, id_column: str, text: str, tokenizer_file: str, length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document.

    Documents are whole texts and the closing id; null is empty. Only documents
    longer than ``length`` are cut.
    """
    chosen = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text}`").alias("__text"))

    def maker():
        if tokenizer_file not in _ENCODERS:
            _ENCODERS[tokenizer_file] = WordEncoder(tokenizer_file)
        encoder, end, step = _ENCODERS[tokenizer_file], np.array([END], dtype="<u4").tobytes(), 4 * length

        def cut(batch: pa.RecordBatch) -> list:
            lengths, sums = [], []
            for ids in encoder.encode_all(texts_of(batch, "__text")):
                ids += end
                parts = [ids[at : at + step] for at in range(0, len(ids), step)]
                lengths.append([len(p) // 4 for p in parts])
                sums.append([zlib.crc32(p) for p in parts])
            return [lengths, sums]

        return cut

    fields = [StructField("lengths", ArrayType(LongType())), StructField("sums", ArrayType(LongType()))]
    return (
        with_columns_of(chosen, ["doc_id"], fields, maker)
        .select("doc_id", F.posexplode(F.arrays_zip("lengths", "sums")).alias("piece", "p"))
        .select(
            "doc_id",
            "piece",
            (F.col("piece").cast("long") * length).alias("start"),
            F.col("p.lengths").alias("length"),
            F.col("p.sums").alias("ids_crc32"),
        )
    )


class Plan:
    """Slots for pieces of each length, from the numbers of pieces per length.

    A slot (length, first, count, sequence, offset) puts the pieces first,
    first + 1, ... of a length into the sequences sequence, sequence + 1, ...
    at the same offset.
    """

    def __init__(self, available: dict[int, int], length: int = LENGTH):
        self.length = length
        self.left = np.zeros(length + 1, dtype=np.int64)
        for size, n in available.items():
            self.left[size] = n
        self.used = np.zeros(length + 1, dtype=np.int64)
        self.slots: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        for size in range(length, 0, -1):
            self.fill_exactly(size)
        self.fit_best()

    def put(self, size: int, count: int, sequence: int, offset: int) -> None:
        self.slots.append((size, int(self.used[size]), count, sequence, offset))
        self.used[size] += count
        self.left[size] -= count

    def open(self, sizes: tuple[int, ...], count: int) -> None:
        """``count`` new sequences with one piece of each of ``sizes``."""
        offset = 0
        for size in sizes:
            self.put(size, count, self.sequences, offset)
            offset += size
        self.sequences += count

    def times(self, sizes: tuple[int, ...]) -> int:
        """How often the combination can be had."""
        return min(int(self.left[s]) // sizes.count(s) for s in set(sizes))

    def fill_exactly(self, size: int) -> None:
        gap = self.length - size
        for sizes in self.complements(gap):
            if not self.left[size]:
                return
            if n := self.times((size, *sizes)):
                self.open((size, *sizes), n)

    def complements(self, gap: int):
        """Available lengths that add up to ``gap``: one, two, then three of them."""
        if gap == 0:
            yield ()
            return
        if self.left[gap]:
            yield (gap,)
        for a in self.pairs(gap):
            yield (gap - a, a)
        for a in np.flatnonzero(self.left[: gap + 1])[::-1]:
            if 3 * a < gap:
                return
            for b in self.pairs(gap - int(a)):
                yield (int(a), gap - int(a) - b, b)

    def pairs(self, gap: int) -> list[int]:
        """Lengths up to half of ``gap`` that are available, as is the rest."""
        small = np.arange(1, gap // 2 + 1)
        return small[(self.left[small] > 0) & (self.left[gap - small] > 0)][::-1].tolist()

    def fit_best(self) -> None:
        """Each remaining piece, longest first, into the sequence with least room for it."""
        open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (sequence, count)
        room_for = np.zeros(self.length + 1, dtype=bool)
        for size in range(self.length, 0, -1):
            while n := int(self.left[size]):
                rooms = np.flatnonzero(room_for[size:])
                if len(rooms):
                    room = size + int(rooms[0])
                    first, count = open_[room].pop()
                    room_for[room] = bool(open_[room])
                else:
                    room, first = self.length, self.sequences
                    count = -(-n // (room // size))
                    self.sequences += count
                each = min(room // size, n)
                full = min(count, n // each)
                for i in range(each):
                    self.put(size, full, first, self.length - room + i * size)
                for rest, start, k in ((room - each * size, first, full), (room, first + full, count - full)):
                    if k and rest:
                        open_[rest].append((start, k))
                        room_for[rest] = True


def pack(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (doc_id, piece, start, length, ids_crc32, ...).

    Sequences hold ``length`` tokens at most, without gaps from offset 0. Pieces
    of one length are interchangeable, so they are numbered in the order of their
    ids, in tasks by range; ties are any repeated rows. No pieces, no sequences.
    """
    order = [F.col(c) for c in ("length", "doc_id", "piece", "ids_crc32")]
    numbered = running_sums(pieces.withColumn("__one", F.lit(1).cast("long")), order, ["__one"], "pack-rows")
    counts = numbered.groupBy("length").count().toPandas()  # one row per length: ``length`` rows at most
    available = dict(zip(counts["length"].tolist(), counts["count"].tolist(), strict=True))
    plan = Plan(available, length)
    before = {size: 0 for size in available}
    total = 0
    for size in sorted(available):
        before[size], total = total, total + available[size]
    slots = sorted((before[size] + first, count, sequence, offset) for size, first, count, sequence, offset in plan.slots)
    starts = np.array([s[0] for s in slots], dtype=np.int64)
    sequence = np.array([s[2] for s in slots], dtype=np.int64)
    offsets = np.array([s[3] for s in slots], dtype=np.int64)

    def maker():
        def place(batch: pa.RecordBatch) -> list:
            at = batch.column("before___one").to_numpy(zero_copy_only=False).astype(np.int64)
            slot = np.searchsorted(starts, at, side="right") - 1
            return [sequence[slot] + at - starts[slot], offsets[slot]]

        return place

    fields = [StructField("sequence_id", LongType()), StructField("offset", LongType())]
    return with_columns_of(numbered, pieces.columns, fields, maker)


def packed_documents(
    docs: DataFrame, tokenizer_file: str, id_column: str = "doc_id", text: str = "text", length: int = LENGTH
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all documents.

    Empty and null texts are documents of one token. Repeated rows are packed as
    often as they occur.
    """
    return pack(stored(pieces_of(docs, id_column, text, tokenizer_file, length), "pieces"), length)
