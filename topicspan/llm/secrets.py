"""Secret scans: patterns, and sliding-window entropy over candidate strings.

Everything is DataFrame expressions. A candidate is a run of characters that
keys are made of. A window slides over it; counts of the characters in the
window change by one that enters and one that leaves, and with them the sum of
``n * log2(n)``, from which Shannon's entropy follows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, in the order of their kinds.
ASSIGN = (
    "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
# A match of it whose value, behind the separator, has six characters or more.
LONG_ASSIGN = f"^{ASSIGN.removesuffix('+)')}{{6,}})$"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
# Alphabet and bits from which a window counts as random, per class of candidates.
CLASSES: dict[str, tuple[str, str, float]] = {
    "hex": ("^[0-9a-fA-F]+$", "0123456789abcdefABCDEF", 3.0),
    "one case": (
        "^([0-9a-z+/_=-]+|[0-9A-Z+/_=-]+)$",
        "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-",
        3.4,
    ),
    "mixed": (
        "",
        "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-",
        3.5,
    ),
}
# Candidates that look random and are not: words, numbers, UUIDs, stated examples.
ALLOWED = (
    "^[A-Za-z+/_=-]+$",
    "^[0-9+/_=-]+$",
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "(?i)example|sample|dummy|placeholder|your[_-]",
    "^([A-Za-z]+[/_=+-]+)*[A-Za-z]+[0-9]{0,4}$",
)
SCALE = 1_000_000
MASK = "[SECRET]"

SPAN = "array<struct<start:int,kind:int,end:int>>"


def found(text: Column, pattern: str, kind: int, keep: str | None = None) -> Column:
    """Spans of the matches of ``pattern``, leftmost first, in code points.

    The text is split at its matches; the lengths of what lies between and of
    the matches add up to the places. ``keep``: a pattern that a match must also
    have.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.zip_with(
        F.slice(between, F.lit(1), F.greatest(F.size(matches), F.lit(0))),
        matches,
        lambda gap, match: F.struct(
            F.length(gap).alias("gap"),
            F.length(match).alias("size"),
            (match.rlike(keep) if keep else F.lit(True)).alias("ok"),
        ),
    )
    walked = F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("at"), F.lit(None).cast(SPAN).alias("spans")),
        lambda acc, p: F.struct(
            (acc.at + p.gap + p.size).alias("at"),
            F.when(
                p.ok,
                F.concat(
                    F.coalesce(acc.spans, F.array().cast(SPAN)),
                    F.array(
                        F.struct(
                            (acc.at + p.gap).alias("start"),
                            F.lit(kind).alias("kind"),
                            (acc.at + p.gap + p.size).alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(acc.spans)
            .alias("spans"),
        ),
    ).spans
    return F.coalesce(F.when(text.rlike(pattern), walked), F.array().cast(SPAN))


def looks_random(candidate: Column) -> Column:
    """Does a window of ``candidate`` reach the entropy that its class asks for?"""
    # n * log2(n) for every count a window can hold, in millionths.
    weights = F.array(
        *[F.lit(round(n * math.log2(n) * SCALE) if n else 0) for n in range(WINDOW + 1)]
    )

    def scan(alphabet: str, bits: float) -> Column:
        # H = log2(window) - sum(n * log2(n)) / window
        most = int((math.log2(WINDOW) - bits) * WINDOW * SCALE)

        def place(i: Column) -> Column:
            return F.instr(F.lit(alphabet), F.substring(candidate, i, F.lit(1)))

        def weight(n: Column) -> Column:
            return F.element_at(weights, n + 1)

        def step(acc: Column, i: Column) -> Column:
            enters = place(i)
            leaves = F.when(i > WINDOW, place(i - WINDOW)).otherwise(F.lit(0))
            into = F.element_at(acc.counts, enters)
            out = F.when(leaves > 0, F.element_at(acc.counts, F.greatest(leaves, F.lit(1)))).otherwise(0)
            change = (
                weight(into + 1)
                - weight(into)
                + F.when(out > 0, weight(out - 1) - weight(out)).otherwise(0)
            )
            # One character in, one out: two counts change by one, or none does.
            same = enters == leaves
            total = F.when(same, acc.total).otherwise(acc.total + change)
            counts = F.when(same, acc.counts).otherwise(
                F.transform(
                    acc.counts,
                    lambda n, j: n
                    + F.when(j + 1 == enters, 1).otherwise(0)
                    - F.when(j + 1 == leaves, 1).otherwise(0),
                )
            )
            return F.struct(
                counts.alias("counts"),
                total.cast("int").alias("total"),
                (acc.hit | ((i >= WINDOW) & (total <= most))).alias("hit"),
            )

        start = F.struct(
            F.array_repeat(F.lit(0), len(alphabet)).alias("counts"),
            F.lit(0).alias("total"),
            F.lit(False).alias("hit"),
        )
        return F.aggregate(F.sequence(F.lit(1), F.length(candidate)), start, step).hit

    by_class = F.coalesce(
        *[
            F.when(candidate.rlike(pattern) if pattern else F.lit(True), scan(alphabet, bits))
            for pattern, alphabet, bits in CLASSES.values()
        ]
    )
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | candidate.rlike(pattern)
    return F.when(allowed, False).otherwise(by_class)


def scan_secrets(docs: DataFrame, keep: Sequence[Column], text: Column) -> DataFrame:
    """``keep`` columns with ``__text``, ``base`` and ``spans``: arrays of (start, kind, end).

    ``base`` holds the matches of the three patterns; a match of ``assign`` counts
    if its value has six characters or more. ``spans`` adds the candidates with a
    window of high entropy, whole, unless a base span covers them. Places are code points, ends exclusive.
    Null texts are empty and have no spans; rows are neither lost nor merged.
    """
    rows = docs.select(*keep, F.coalesce(text, F.lit("")).alias("__text"))
    t = F.col("__text")
    scanned = rows.select(
        *rows.columns,
        found(t, ASSIGN, 0, LONG_ASSIGN).alias("__assign"),
        F.when(t.contains("AKIA"), found(t, ACCESS, 1))
        .otherwise(F.array().cast(SPAN))
        .alias("__access"),
        found(t, HEX, 2).alias("__hex"),
        found(t, CANDIDATE, 3).alias("__candidates"),
    ).withColumn("base", F.array_sort(F.concat("__assign", "__access", "__hex")))
    added = F.filter(
        "__candidates",
        lambda c: ~F.exists("base", lambda b: (b.start <= c.start) & (b.end >= c.end))
        & looks_random(F.substring(t, c.start + 1, c.end - c.start)),
    )
    return scanned.withColumn(
        "spans",
        F.when(F.size("__candidates") > 0, F.array_sort(F.concat("base", added))).otherwise(F.col("base")),
    ).drop("__assign", "__access", "__hex", "__candidates")


def described(spans: Column) -> Column:
    """``kind:start:end`` of all spans by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start, s.end)), ","
    )


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every run of covered characters replaced by a mark."""
    walked = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s.end <= acc.at, acc).otherwise(
            F.struct(
                s.end.alias("at"),
                F.when(
                    (s.start < acc.at) | ((s.start == acc.at) & (acc.at > 0)), acc.out
                ).otherwise(
                    F.concat(acc.out, F.substring(text, acc.at + 1, s.start - acc.at), F.lit(MASK))
                ).alias("out"),
            )
        ),
    )
    return F.when(
        F.size(spans) > 0,
        F.concat(walked.out, F.substring(text, walked.at + 1, F.length(text))),
    ).otherwise(text)


def without_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by a mark; no row is dropped.

    A column ``n_chars`` holds the length of the new text where it changed.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    scanned = scan_secrets(docs, [row], F.col(f"`{text}`"))
    new = scanned.withColumn("__new", masked(F.col("__text"), F.col("spans")))
    kept = {c: F.col(f"__row.`{c}`") for c in docs.columns}
    hit = F.size("spans") > 0
    if "n_chars" in kept:
        kept["n_chars"] = F.when(
            hit, F.length("__new").cast(docs.schema["n_chars"].dataType)
        ).otherwise(kept["n_chars"])
    kept[text] = F.when(hit, F.col("__new")).otherwise(kept[text])
    return new.select(*[value.alias(name) for name, value in kept.items()])
