"""Text expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word is a run of letters and digits, with inner apostrophes kept.
WORD_PATTERN = r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)*"


def word_array(text: Column | str) -> Column:
    """Lower-cased words of a text, in reading order, punctuation removed."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))


def word_runs(words: str, n: int = 3) -> Column:
    """All runs of ``n`` neighbouring words of the array column ``words``, as structs (w0, w1, ...).

    Shifted copies of the array lie side by side: Spark compiles these functions,
    where a lambda over positions is interpreted. Texts of fewer than ``n`` words have none.
    """
    size = F.greatest(F.size(words) - F.lit(n - 1), F.lit(0))
    return F.arrays_zip(*[F.slice(words, i + 1, size).alias(f"w{i}") for i in range(n)])


def starts_with_term(ngram: Column, term: Column, word_boundary: bool = False) -> Column:
    """Prefix test. By default "cupboard is bare" starts with "cup"."""
    if word_boundary:
        return F.startswith(F.concat(ngram, F.lit(" ")), F.concat(term, F.lit(" ")))
    return F.startswith(ngram, term)
