"""Token counts of a BPE vocabulary by rank-synchronous array merging.

Texts are cut before every word mark; no piece of the vocabulary crosses such a
cut. The distinct pre-tokens of a batch lie end to end in one numpy array, and
each round merges, in every pre-token at once, the pair that ranks lowest there.
"""

from __future__ import annotations

import heapq


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField

from topicspan.llm.common import texts_of, with_columns_of

MARK = "▁"  # stands for a space
# Pre-tokens remembered by a worker; when full, the memory starts anew.
REMEMBERED = 400_000
# Pre-tokens of more symbols are merged one by one with a heap: same result, no quadratic time.
LONG = 2048
NEVER = np.int64(1) << 60


class PieceCounter:
    """Counts tokens as the sentencepiece library does for a BPE model.

    Pairs are merged by score, best first, the leftmost of equals first.
    Characters without a piece count as their UTF-8 bytes.
    """

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models without normalisation are supported")
        self.prefix = MARK if spec.add_dummy_prefix else ""
        scores = {p.piece: p.score for p in model.pieces if p.type == 1}
        if any(MARK in p.lstrip(MARK) for p in scores):
            raise ValueError("a piece goes on after a later word mark")
        self.bytes_known = model.trainer_spec.byte_fallback
        ranks = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {p: ranks[s] for p, s in scores.items()}
        self.symbols = {}  # text of a symbol -> number
        for p in scores:
            self.symbols.setdefault(p, len(self.symbols))
        for p in scores:
            for ch in p:
                self.symbols.setdefault(ch, len(self.symbols))
        self.other = len(self.symbols)  # any character that no piece has
        self.width = self.other + 1
        pairs = [
            (self.symbols[p[:i]] * self.width + self.symbols[p[i:]], self.rank[p], self.symbols[p])
            for p in scores
            for i in range(1, len(p))
            if p[:i] in self.symbols and p[i:] in self.symbols
        ]
        pairs.sort()
        self.keys = np.array([k for k, _, _ in pairs] + [NEVER], dtype=np.int64)
        self.key_rank = np.array([r for _, r, _ in pairs] + [NEVER], dtype=np.int64)
        self.key_made = np.array([m for _, _, m in pairs] + [0], dtype=np.int64)
        # All places of a rank may merge in one round if a merge never makes room
        # for a pair of the same or a better rank.
        at_once = np.ones(len(ranks), dtype=bool)
        for p, r in self.rank.items():
            for i in range(1, len(p)):
                for part in (p[:i], p[i:]):
                    if part in self.rank and self.rank[part] >= r:
                        at_once[self.rank[part]] = False
        shared = np.bincount(list(self.rank.values()), minlength=len(ranks)) > 1
        self.at_once = np.append(at_once & ~shared, False)
        self.cost = np.ones(self.width, dtype=np.int64)
        for s, number in self.symbols.items():
            if s not in self.rank:
                self.cost[number] = len(s.encode()) if self.bytes_known else 1
        self.seen: dict[str, int] = {}

    def count(self, text: str | None) -> int:
        """Tokens of one text; null is empty."""
        return self.count_all([text])[0]

    def count_all(self, texts: list[str | None]) -> list[int]:
        cut = [self.pre_tokens(t) for t in texts]
        new = list({w for words in cut for w in words if w not in self.seen})
        if len(self.seen) + len(new) > REMEMBERED:
            self.seen = {}
            new = list({w for words in cut for w in words})
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            self.seen.update(zip(part, self.merge(part), strict=True))
        seen = self.seen
        return [sum(map(seen.__getitem__, words)) for words in cut]

    def pre_tokens(self, text: str | None) -> list[str]:
        if not text:
            return []
        words = (self.prefix + text).replace(" ", MARK).split(MARK)
        # A run of marks stays with the word behind it.
        out, marks = [], 0
        if words[0]:
            out.append(words[0])
        for w in words[1:]:
            marks += 1
            if w:
                out.append(MARK * marks + w)
                marks = 0
        if marks:
            out.append(MARK * marks)
        return out

    def merge(self, words: list[str]) -> list[int]:
        """Surviving symbols of each word, in bytes where a symbol is no piece."""
        counts = np.zeros(len(words), dtype=np.int64)
        short = []
        for i, w in enumerate(words):
            if len(w) > LONG:
                counts[i] = self.merge_long(w)
            else:
                short.append(i)
        if not short:
            return counts.tolist()
        chars = "".join(words[i] for i in short)
        lengths = np.array([len(words[i]) for i in short])
        codes = np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kinds, where = np.unique(codes, return_inverse=True)
        known = np.array([self.symbols.get(chr(c), self.other) for c in kinds], dtype=np.int64)
        utf8 = np.array([len(chr(c).encode("utf-8", "surrogatepass")) for c in kinds])
        sym = known[where]
        extra = np.where(known == self.other, utf8 - 1 if self.bytes_known else 0, 0)[where]
        owner = np.repeat(np.arange(len(short)), lengths)
        ids = np.array(short)
        np.add.at(counts, ids[owner], extra)
        while len(sym) > 1:
            key = sym[:-1] * self.width + sym[1:]
            at = np.searchsorted(self.keys, key)
            rank = np.where((self.keys[at] == key) & (owner[:-1] == owner[1:]), self.key_rank[at], NEVER)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            low = np.minimum.reduceat(np.append(rank, NEVER), first)
            span = np.diff(np.append(first, len(sym)))
            of = np.repeat(low, span)[:-1]
            hit = (rank == of) & (rank < NEVER)
            if not hit.any():
                break
            places = np.flatnonzero(hit)
            once = self.at_once[np.minimum(rank[places], len(self.at_once) - 1)]
            lead = np.r_[True, owner[places][1:] != owner[places][:-1]]
            places = places[once | lead]
            # Overlapping places: from the left, every other one of a run.
            run = np.r_[True, np.diff(places) > 1]
            begin = places[np.maximum.accumulate(np.where(run, np.arange(len(places)), 0))]
            places = places[(places - begin) % 2 == 0]
            sym[places] = self.key_made[np.searchsorted(self.keys, key[places])]
            keep = np.ones(len(sym), dtype=bool)
            keep[places + 1] = False
            # Words in which nothing can merge any more leave the arrays.
            done = np.repeat(low == NEVER, span)
            out = keep & done
            np.add.at(counts, ids[owner[out]], self.cost[sym[out]])
            keep &= ~done
            sym, owner = sym[keep], owner[keep]
        np.add.at(counts, ids[owner], self.cost[sym])
        return counts.tolist()

    def merge_long(self, word: str) -> int:
        """The same merges for one long word: linked symbols and a heap of pairs."""
        parts = list(word)
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, str]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right >= 0:
                made = parts[left] + parts[right]
                if (rank := self.rank.get(made)) is not None:
                    heapq.heappush(heap, (rank, left, made))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, left, made = heapq.heappop(heap)
            right = after[left]
            if not parts[left] or right < 0 or parts[left] + parts[right] != made:
                continue
            parts[left], parts[right] = made, ""
            after[left] = after[right]
            if after[left] >= 0:
                before[after[left]] = left
            offer(before[left], left)
            offer(left, after[left])
        return sum(
            1 if p in self.rank or not self.bytes_known else len(p.encode()) for p in parts if p
        )


_COUNTERS: dict[str, PieceCounter] = {}


def counter_for(model_file: str) -> PieceCounter:
    """One counter per worker process and model."""
    if model_file not in _COUNTERS:
        _COUNTERS[model_file] = PieceCounter(model_file)
    return _COUNTERS[model_file]


def count_tokens(
    docs: DataFrame, text: Column, model_file: str, keep: list[Column], limit: int = 4096
) -> DataFrame:
    """``keep`` columns with n_bytes, n_tokens and over_limit (n_tokens > limit).

    Whole texts are counted, whatever their length; null and empty texts have 0
    bytes and tokens. Equal rows give equal results, one per row. The model file
    is read on each executor.
    """
    chosen = docs.select(*keep, text.alias("__text"))
    fields = [
        StructField("n_bytes", LongType()),
        StructField("n_tokens", LongType()),
        StructField("over_limit", BooleanType()),
    ]

    def maker():
        counter = counter_for(model_file)

        def count(batch: pa.RecordBatch) -> list:
            texts = texts_of(batch, "__text")
            tokens = counter.count_all(texts)
            return [[len(t.encode()) for t in texts], tokens, [n > limit for n in tokens]]

        return count

    return with_columns_of(chosen, chosen.columns[:-1], fields, maker)
