"""The secret scan as DuckDB SQL, for the check of its query."""

from __future__ import annotations

import math

from topicspan.llm.secrets import ACCESS, ALLOWED, CANDIDATE, CLASSES, HEX, KINDS, SCALE, WINDOW

_KEYS = "|".join("".join(f"[{c.upper()}{c}]" for c in w) for w in ("password", "passwd", "secret", "token"))
_ASSIGN = f"""({_KEYS}|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\\x20*[:=]\\x20*["'']?[A-Za-z0-9+/_.=-]+"""


def _found(kind: int, pattern: str, keep: str = "true") -> str:
    return f"""
  SELECT row, {kind} AS kind,
         CAST(sum(length(gap) + length(m)) OVER (PARTITION BY row ORDER BY i) AS BIGINT) - length(m) AS start, m
  FROM (
    SELECT row, unnest(matches) AS m, unnest(gaps[1 : len(matches)]) AS gap, unnest(range(1, len(matches) + 1)) AS i
    FROM (SELECT row, regexp_extract_all(text, '{pattern}') AS matches,
                 string_split_regex(text, '{pattern}') AS gaps FROM d)
  ) QUALIFY {keep}"""


def secrets_sql() -> str:
    weight = "CASE n " + " ".join(
        f"WHEN {n} THEN {round(n * math.log2(n) * SCALE)}" for n in range(1, WINDOW + 1)
    ) + " END"
    most = "CASE " + " ".join(
        f"WHEN {f'regexp_matches(m, {pattern!r})' if pattern else 'true'} "
        f"THEN {int((math.log2(WINDOW) - bits) * WINDOW * SCALE)}"
        for pattern, _, bits in CLASSES.values()
    ) + " END"
    allowed = " OR ".join(f"regexp_matches(m, '{p}')" for p in ALLOWED)
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    told = f"string_agg({names}[kind + 1] || ':' || start || ':' || (start + length(m)), ',' ORDER BY start, kind)"
    return f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
), base AS MATERIALIZED ({_found(0, _ASSIGN, "regexp_matches(m, '[A-Za-z0-9+/_.=-]{6}$')")}
  UNION ALL {_found(1, ACCESS)}
  UNION ALL {_found(2, HEX)}
), open AS MATERIALIZED (
  SELECT c.* FROM ({_found(3, CANDIDATE)}) c
  WHERE NOT ({allowed}) AND NOT EXISTS (
    SELECT 1 FROM base b
    WHERE b.row = c.row AND b.start <= c.start AND b.start + length(b.m) >= c.start + length(c.m))
), windows AS (
  SELECT row, start, m, w, substr(m, w + i, 1) AS letter
  FROM (SELECT *, unnest(range(1, length(m) - {WINDOW - 2})) AS w FROM open), range({WINDOW}) r(i)
), counted AS (
  SELECT row, start, m, w, letter, count(*) AS n FROM windows GROUP BY ALL
), added AS (
  SELECT DISTINCT row, 3 AS kind, start, m
  FROM (SELECT row, start, m, w, sum({weight}) AS total FROM counted GROUP BY ALL)
  WHERE total <= {most}
), every AS (SELECT row, kind, start, m FROM base UNION ALL SELECT row, kind, start, m FROM added),
b AS (
  SELECT row, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS c, count(*) FILTER (kind = 2) AS h,
         {told} AS told
  FROM base GROUP BY row
), s AS (SELECT row, {told} AS told FROM every GROUP BY row)
SELECT d.doc_id, coalesce(b.a, 0) AS n_assign, coalesce(b.c, 0) AS n_access, coalesce(b.h, 0) AS n_hex,
       sha256(coalesce(b.told, '')) AS base_sha256, coalesce(s.told, '') AS spans
FROM d LEFT JOIN b ON b.row = d.row LEFT JOIN s ON s.row = d.row
"""
