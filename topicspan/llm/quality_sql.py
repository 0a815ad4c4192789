"""The quality rules as DuckDB SQL, for the check of their query."""

from __future__ import annotations

from topicspan.llm.common import SPACES
from topicspan.llm.quality_rules import BITS, FENCE, LEAST_WORDS, MOST_REPEATED, RATES, SYMBOLS, WINDOW


def quality_sql() -> str:
    rates = "\n  UNION ALL ".join(
        f"SELECT row, lang, source, base_failed, '{name}' AS rate, {low} AS least, {rate.replace(' div ', ' // ')} AS value FROM m"
        for name, (rate, low) in RATES.items()
    )

    def fence(name: str, groups: str) -> str:
        return f"""
{name} AS (
  SELECT {groups}, rate, q2 + {FENCE} * greatest(q2 - q1, least) AS fence
  FROM (
    SELECT {groups}, rate, any_value(least) AS least,
           min(bucket) FILTER (4 * upto >= alle) AS q1, min(bucket) FILTER (4 * upto >= 2 * alle) AS q2
    FROM (
      SELECT *, sum(n) OVER (PARTITION BY {groups}, rate ORDER BY bucket) AS upto,
             sum(n) OVER (PARTITION BY {groups}, rate) AS alle
      FROM (SELECT {groups}, rate, least, bucket, count(*) AS n FROM bucketed WHERE NOT base_failed GROUP BY ALL)
    ) GROUP BY {groups}, rate))"""

    return f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, lang, source, coalesce(text, '') AS text FROM documents
), w AS MATERIALIZED (
  SELECT row, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i
  FROM (SELECT row, regexp_extract_all(text, '[^{SPACES}]+') AS words FROM d)
), grams AS (
  SELECT row, i, string_agg(word, ' ') OVER ahead AS gram, count(*) OVER ahead AS size
  FROM w WINDOW ahead AS (PARTITION BY row ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)
), twice AS (
  SELECT row, i FROM (SELECT *, count(*) OVER (PARTITION BY row, gram) AS c FROM grams WHERE size = {WINDOW}) WHERE c > 1
), repeated AS (
  SELECT row, count(DISTINCT i + j) AS n FROM twice, range({WINDOW}) r(j) GROUP BY row
), lines AS (
  SELECT row, count(*) - count(DISTINCT line) AS n
  FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^{SPACES}]') GROUP BY row
), words AS (
  SELECT row, count(*) AS n, sum(length(word)) AS chars, count(*) FILTER (word = before) AS stutters
  FROM (SELECT *, lag(word) OVER (PARTITION BY row ORDER BY i) AS before FROM w) GROUP BY row
), m AS MATERIALIZED (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed
  FROM (
    SELECT d.row, d.doc_id, d.lang, d.source, coalesce(words.n, 0)::BIGINT AS n_words,
           coalesce(words.chars, 0)::BIGINT AS word_chars,
           len(regexp_extract_all(d.text, '[{SYMBOLS}]'))::BIGINT AS n_symbols,
           coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words,
           len(regexp_extract_all(d.text, '!'))::BIGINT AS n_bangs,
           len(regexp_extract_all(d.text, '[A-Z]'))::BIGINT AS n_capitals,
           coalesce(words.stutters, 0)::BIGINT AS n_stutters
    FROM d LEFT JOIN words USING (row) LEFT JOIN lines USING (row) LEFT JOIN repeated USING (row))
), rated AS (
  {rates}
), bucketed AS MATERIALIZED (
  SELECT *, (value >> shift) << shift AS bucket
  FROM (SELECT *, greatest(length(bin(value)) - {BITS}, 0)::BIGINT AS shift FROM rated)
),{fence("per_source", "lang, source")},{fence("per_lang", "lang")},
outlying AS (
  SELECT DISTINCT b.row
  FROM bucketed b
  JOIN per_source s ON s.lang IS NOT DISTINCT FROM b.lang AND s.source IS NOT DISTINCT FROM b.source AND s.rate = b.rate
  JOIN per_lang l ON l.lang IS NOT DISTINCT FROM b.lang AND l.rate = b.rate
  WHERE b.value > greatest(s.fence, l.fence)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND row NOT IN (SELECT row FROM outlying) AS kept
FROM m
"""
