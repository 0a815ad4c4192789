"""The registered queries as DuckDB SQL over the same tables.

Written from the definitions, with windows and plain joins, and not after the
Spark plans.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from topicspan.functions import WORD_PATTERN
from topicspan.operators.splits import DEFAULT_FRACTIONS, SCREEN_FRACTIONS


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _words(text: str) -> str:
    return f"unnest(regexp_extract_all(lower({text}), {_quoted(WORD_PATTERN)}))"


def _corpus(label: str = "lang") -> str:
    return f"""
corpus AS (
  SELECT CAST(doc_id AS VARCHAR) AS docid, text, {label} AS appTag,
         CAST(dense_rank() OVER (ORDER BY {label}) AS INTEGER) AS topic
  FROM documents),
k AS (SELECT count(DISTINCT appTag) AS k FROM corpus)"""


def _tokens(stop_words: Sequence[str]) -> str:
    listed = ", ".join(f"({_quoted(w)})" for w in stop_words)
    return f"""
stop(word) AS (VALUES {listed}),
all_words AS (SELECT docid, topic, {_words("text")} AS word FROM corpus),
kept AS (SELECT * FROM all_words WHERE word NOT IN (SELECT word FROM stop)),
counts AS (SELECT docid, word, count(*) AS n FROM kept GROUP BY docid, word)"""


def _weights(counts: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT docid, word, n, n / total AS tf, ln(docs / df) AS idf, n / total * ln(docs / df) AS tf_idf
  FROM (SELECT docid, word, n,
               sum(n) OVER (PARTITION BY docid) AS total,
               count(*) OVER (PARTITION BY word) AS df,
               (SELECT count(DISTINCT docid) FROM {counts}) AS docs
        FROM {counts}))"""


_BETA = """
grid AS (
  SELECT t.topic, v.word
  FROM (SELECT DISTINCT topic FROM corpus) t, (SELECT DISTINCT word FROM kept) v),
per_topic AS (SELECT topic, word, count(*) AS n FROM kept GROUP BY topic, word),
smooth AS (
  SELECT g.topic, g.word, coalesce(p.n, 0) AS n
  FROM grid g LEFT JOIN per_topic p ON p.topic = g.topic AND p.word = g.word),
beta AS (
  SELECT topic, word AS term,
         CAST(n + 1 AS DOUBLE) / CAST(sum(n + 1) OVER (PARTITION BY topic) AS DOUBLE) AS beta
  FROM smooth),
top AS (
  SELECT topic, term, beta
  FROM (SELECT *, rank() OVER (PARTITION BY topic ORDER BY beta DESC) AS r FROM beta)
  WHERE r <= 10)"""


def _posterior(counts: str, name: str) -> str:
    return f"""
{name}_score AS (
  SELECT c.docid, b.topic, sum(c.n * ln(b.beta)) AS s
  FROM {counts} c JOIN beta b ON b.term = c.word GROUP BY c.docid, b.topic),
{name}_exp AS (
  SELECT docid, topic, exp(s - max(s) OVER (PARTITION BY docid)) AS e FROM {name}_score),
{name} AS (
  SELECT docid, topic, round(e / sum(e) OVER (PARTITION BY docid), 6) AS probability
  FROM {name}_exp),
{name}_best AS (
  SELECT docid, topic, probability
  FROM (SELECT *, row_number() OVER (PARTITION BY docid ORDER BY probability DESC, topic) AS r
        FROM {name})
  WHERE r = 1)"""


_CLUSTERED = """
clustered AS (
  SELECT b.topic, 'topic' || b.topic AS label, c.docid, c.text, b.probability
  FROM posterior_best b JOIN corpus c ON c.docid = b.docid)"""

_NEW = f"""
fresh AS (
  SELECT CAST((SELECT max(doc_id) FROM documents)
              + row_number() OVER (ORDER BY item_id) AS VARCHAR) AS docid, text
  FROM benchmark),
fresh_words AS (
  SELECT docid, word FROM (SELECT docid, {_words("text")} AS word FROM fresh)
  WHERE word IN (SELECT word FROM counts)),
fresh_counts AS (
  SELECT docid, word, count(*) AS n FROM fresh_words
  WHERE word NOT IN (SELECT word FROM stop) GROUP BY docid, word),
united AS (SELECT * FROM counts UNION ALL SELECT * FROM fresh_counts)"""


def _ngrams(n: int) -> str:
    following = ", ".join(f"lead(word, {i}) OVER w AS w{i}" for i in range(1, n))
    joined = " || ' ' || ".join(["word", *[f"w{i}" for i in range(1, n)]])
    return f"""
placed AS (
  SELECT docid, topic, unnest(words) AS word, generate_subscripts(words, 1) AS pos
  FROM (SELECT docid, topic, regexp_extract_all(lower(text), {_quoted(WORD_PATTERN)}) AS words FROM corpus)),
runs AS (
  SELECT topic, {joined} AS bigram
  FROM (SELECT docid, topic, word, {following} FROM placed WINDOW w AS (PARTITION BY docid ORDER BY pos))
  WHERE w{n - 1} IS NOT NULL),
grams AS (SELECT bigram, topic, count(*) AS n FROM runs GROUP BY bigram, topic)"""


def _matches(word_boundary: bool = False) -> str:
    test = (
        "starts_with(g.bigram || ' ', t.term || ' ')" if word_boundary else "starts_with(g.bigram, t.term)"
    )
    return f"""
matches AS (
  SELECT t.topic, t.term, t.beta, g.bigram, g.n
  FROM top t JOIN grams g ON g.topic = t.topic AND {test}),
strongest AS (
  SELECT * FROM (SELECT *, max(beta) OVER (PARTITION BY topic) AS mb FROM matches) WHERE beta = mb),
candidates AS (
  SELECT topic, term, beta, bigram, n
  FROM (SELECT *, max(n) OVER (PARTITION BY topic) AS mn FROM strongest) WHERE n = mn)"""


_SUGGESTED = """
SELECT topic, 'unknown' AS label, string_agg(bigram, ',' ORDER BY bigram) AS suggestions
FROM candidates GROUP BY topic"""

_RATIO = """
ratio AS (
  SELECT o.term, o.topic, round(log2(o.beta / s.beta), 6) AS log_ratio
  FROM beta o JOIN top s ON s.term = o.term AND s.topic = 2 WHERE o.topic <> 2)"""


def _split(rows: str, fractions: Sequence[float], seed: int = 1234) -> str:
    train, upto = float(fractions[0]), float(fractions[0] + fractions[1])
    return f"""
split AS (
  SELECT docid, label,
         CASE WHEN r <= ceil(CAST({train!r} AS DOUBLE) * n) THEN 'train'
              WHEN r <= ceil(CAST({upto!r} AS DOUBLE) * n) THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT docid, label,
               row_number() OVER (PARTITION BY label ORDER BY md5(docid || ':{seed}')) AS r,
               count(*) OVER (PARTITION BY label) AS n
        FROM {rows}))"""


_QUALITY = """
quality AS (
  SELECT CAST(doc_id AS VARCHAR) AS docid, 'quality-' || quality || '-toxic-' || toxic AS label
  FROM labels)"""

_LABELLED = "labelled AS (SELECT docid, appTag AS label FROM corpus)"

_HOT = """
SELECT l.docid, l.label, c.label AS class, CAST(l.label = c.label AS INTEGER) AS indicator
FROM labelled l, (SELECT DISTINCT label FROM labelled) c"""


# Relations that several others read: each is to be computed once.
_SHARED = re.compile(r"^(corpus|kept|counts|beta|top|posterior|grams) AS \(", re.MULTILINE)


def _with(*parts: str, select: str) -> str:
    relations = _SHARED.sub(r"\1 AS MATERIALIZED (", ",\n".join(p.strip() for p in parts))
    return f"WITH {relations}\n{select.strip()}"


def build(stop_words: Sequence[str]) -> dict[str, str]:
    corpus, tok = _corpus(), _tokens(stop_words)
    base = (corpus, tok)
    weighted = (*base, _weights("counts", "weights"))
    topical = (*base, _BETA)
    posterior = (*topical, _posterior("counts", "posterior"))
    clustered = (*posterior, _CLUSTERED)
    fresh = (*base, _NEW)
    suggestions = (*topical, _ngrams(3), _matches())
    return {
        "corpus_rows": """
SELECT CAST(row_number() OVER (ORDER BY conv_id, turn) AS VARCHAR) AS docid, text, role AS "appTag"
FROM conversations""",
        "csv_roundtrip": """
SELECT CAST(doc_id AS VARCHAR) AS docid, text, lang AS "appTag" FROM documents""",
        "token_counts": _with(*base, select="SELECT docid, word, n FROM counts"),
        "vocabulary": _with(*base, select="SELECT DISTINCT word FROM kept"),
        "corpus_totals": _with(*base, select="""
SELECT (SELECT count(DISTINCT docid) FROM kept) AS documents,
       (SELECT count(DISTINCT word) FROM kept) AS features,
       (SELECT count(DISTINCT appTag) FROM corpus) AS classes"""),
        "frequent_tokens_preview": _with(*base, select="""
SELECT docid, word, n FROM counts ORDER BY n DESC, docid, word LIMIT 20"""),
        "ngram_counts": _with(corpus, _ngrams(3), select="SELECT bigram, topic, n FROM grams"),
        "ngrams_per_topic": _with(corpus, _ngrams(2), select="""
SELECT topic, count(*) AS nn FROM grams GROUP BY topic"""),
        "tf_idf": _with(*weighted, select="""
SELECT docid, word, n, round(tf, 6) AS tf, round(idf, 6) AS idf, round(tf_idf, 6) AS tf_idf
FROM weights"""),
        "top_tf_idf_words": _with(*weighted, select="""
SELECT "appTag", docid, word, tf_idf
FROM (SELECT *, rank() OVER (PARTITION BY "appTag" ORDER BY tf_idf DESC) AS r
      FROM (SELECT c.appTag AS "appTag", w.docid, w.word, round(w.tf_idf, 6) AS tf_idf
            FROM weights w JOIN corpus c ON c.docid = w.docid))
WHERE r <= 10"""),
        "corpus_with_new_texts": _with(*fresh, select="""
SELECT docid, text FROM corpus UNION ALL SELECT docid, text FROM fresh"""),
        "new_text_tokens": _with(*fresh, select="SELECT docid, word, n FROM fresh_counts"),
        "new_text_tf_idf": _with(*fresh, _weights("united", "weights"), select="""
SELECT docid, word, n, round(tf, 6) AS tf, round(idf, 6) AS idf, round(tf_idf, 6) AS tf_idf
FROM weights WHERE docid IN (SELECT docid FROM fresh)"""),
        "extended_tf_idf": _with(*fresh, _weights("united", "weights"), select="""
SELECT docid, word, n, round(tf, 6) AS tf, round(idf, 6) AS idf, round(tf_idf, 6) AS tf_idf
FROM weights"""),
        "topic_term_table": _with(*topical, select="SELECT topic, term, beta FROM beta"),
        "top_terms": _with(*topical, select="SELECT topic, term, beta FROM top"),
        "strongest_terms": _with(*topical, select="""
SELECT topic, term, beta
FROM (SELECT *, max(beta) OVER (PARTITION BY topic) AS mb FROM beta) WHERE beta = mb"""),
        "top_terms_page": _with(_corpus("source"), tok, _BETA, select="""
SELECT topic, term, beta,
       ((topic - 1) // 10 * 10 + 1) || '..' || ((topic - 1) // 10 * 10 + 10) AS page
FROM top WHERE topic BETWEEN 11 AND 20"""),
        "top_terms_per_topic": _with(*topical, select="""
SELECT topic, count(*) AS n FROM top GROUP BY topic"""),
        "term_display_order": _with(*topical, select="""
SELECT topic, term, beta, round(avg(beta) OVER (PARTITION BY term), 9) AS mean_beta FROM top"""),
        "log_ratio": _with(*topical, _RATIO, select="SELECT term, topic, log_ratio FROM ratio"),
        "log_ratio_page": _with(*topical, _RATIO, select="""
SELECT term, topic, log_ratio FROM ratio WHERE topic BETWEEN 1 AND 3"""),
        "log_ratio_wide": _with(*topical, _RATIO, select="""
SELECT term, max(log_ratio) FILTER (topic = 1) AS topic_1,
       max(log_ratio) FILTER (topic = 3) AS topic_3, max(log_ratio) FILTER (topic = 4) AS topic_4
FROM ratio GROUP BY term"""),
        "term_ngrams": _with(*suggestions, select="SELECT topic, term, beta, bigram, n FROM matches"),
        "label_candidates": _with(*suggestions, select="""
SELECT topic, term, beta, bigram, n FROM candidates"""),
        "label_suggestions": _with(*suggestions, select=_SUGGESTED),
        "label_suggestions_bigrams": _with(*topical, _ngrams(2), _matches(True), select=_SUGGESTED),
        "doc_topic_argmax": _with(*posterior, select="""
SELECT docid, topic, probability FROM posterior_best"""),
        "doc_topics_ranked": _with(*posterior, select="""
SELECT docid, topic, probability,
       CAST(row_number() OVER (PARTITION BY docid ORDER BY probability DESC, topic) AS INTEGER) AS rank
FROM posterior"""),
        "clustered_docs": _with(*clustered, select="""
SELECT topic, label, docid, text, probability FROM clustered"""),
        "cluster_sizes": _with(*clustered, select="""
SELECT topic, label, count(*) AS n, topic || ' ' || label AS caption
FROM clustered GROUP BY topic, label"""),
        "cluster_filter": _with(*clustered, select="""
SELECT topic, label, docid, probability FROM clustered WHERE topic = 2"""),
        "cluster_export": _with(*clustered, select="""
SELECT topic, label, docid, text, probability FROM clustered WHERE topic = 2"""),
        "related_docs": _with(*clustered, _NEW, _posterior("fresh_counts", "arrived"), select="""
SELECT topic, label, docid, probability FROM clustered
WHERE topic IN (SELECT topic FROM arrived_best)"""),
        "default_label_table": _with(corpus, select="""
SELECT DISTINCT topic, 'unknown' AS label FROM corpus"""),
        "label_override": _with(corpus, select="""
SELECT topic, CASE WHEN count(*) * (SELECT k FROM k) >= (SELECT count(*) FROM corpus)
                   THEN max(appTag) ELSE 'topic' || topic END AS label
FROM corpus GROUP BY topic"""),
        "label_table_roundtrip": _with(_corpus("source"), select="""
SELECT DISTINCT topic, 'topic' || topic AS label FROM corpus"""),
        "feature_rows": _with(*weighted, _QUALITY, select="""
SELECT w.docid, w.word, round(w.tf_idf, 6) AS tf_idf, q.label
FROM weights w JOIN quality q ON q.docid = w.docid"""),
        "stratified_split": _with(corpus, _LABELLED, _split("labelled", DEFAULT_FRACTIONS), select="""
SELECT docid, label, split FROM split"""),
        "class_shares": _with(corpus, _LABELLED, _split("labelled", SCREEN_FRACTIONS), select="""
SELECT split, label, n, round(n / sum(n) OVER (PARTITION BY split), 6) AS pc
FROM (SELECT split, label, count(*) AS n FROM split GROUP BY split, label)"""),
        "one_hot_labels": _with(corpus, _LABELLED, select=_HOT),
        "treatment_contrasts": _with(corpus, _LABELLED, select=_HOT + """
WHERE c.label > (SELECT min(label) FROM labelled)"""),
        "binary_features": _with(*fresh, select="""
SELECT DISTINCT docid, word, CAST(1.0 AS DOUBLE) AS feature FROM fresh_words"""),
        "test_predictions_join": _with(*posterior, """
named AS (SELECT DISTINCT topic, appTag FROM corpus)""", """
predicted AS (
  SELECT b.docid, c.appTag AS label, n.appTag AS predictTag
  FROM posterior_best b JOIN corpus c ON c.docid = b.docid JOIN named n ON n.topic = b.topic)""",
            _split("predicted", DEFAULT_FRACTIONS), select="""
SELECT p.docid, p.label, p.predictTag AS "predictTag", c.text, c.appTag AS "appTag"
FROM predicted p JOIN split s ON s.docid = p.docid AND s.split = 'test'
JOIN corpus c ON c.docid = p.docid"""),
        "evaluate_predictions": _with(*posterior, select="""
SELECT round(avg(-ln(least(greatest(p.probability, CAST(1e-15 AS DOUBLE)),
                           CAST(1.0 AS DOUBLE) - CAST(1e-15 AS DOUBLE)))), 6) AS loss,
       round(avg(CAST(b.topic = c.topic AS INTEGER)), 6) AS accuracy
FROM corpus c JOIN posterior p ON p.docid = c.docid AND p.topic = c.topic
JOIN posterior_best b ON b.docid = c.docid"""),
        "history_by_epoch": """
WITH scored AS (
  SELECT turn AS epoch, role, length(text) / CAST(1000 AS DOUBLE) AS loss,
         CAST(length(text) > 200 AS INTEGER) AS accuracy
  FROM conversations WHERE role IN ('user', 'assistant')),
t AS (SELECT epoch, avg(loss) AS loss, avg(accuracy) AS accuracy FROM scored
      WHERE role = 'user' GROUP BY epoch),
v AS (SELECT epoch, avg(loss) AS loss, avg(accuracy) AS accuracy FROM scored
      WHERE role = 'assistant' GROUP BY epoch)
SELECT t.epoch, round(t.loss, 6) AS "trainLoss", round(t.accuracy, 6) AS "trainAccuracy",
       round(v.loss, 6) AS "valLoss", round(v.accuracy, 6) AS "valAccuracy"
FROM t JOIN v ON v.epoch = t.epoch""",
        "lda_vocabulary": _with(*base, select="""
SELECT CAST(t.topic AS INTEGER) AS topic, (SELECT count(DISTINCT word) FROM kept) AS terms,
       CAST(1.0 AS DOUBLE) AS mass
FROM range(1, 6) t(topic)"""),
        "lda_posterior_mass": _with(*base, select="""
SELECT docid, CAST(5 AS BIGINT) AS topics, CAST(1.0 AS DOUBLE) AS mass
FROM (SELECT DISTINCT docid FROM kept)"""),
        "topic_table_vocabulary": _with(*base, select="""
SELECT CAST(t.topic AS INTEGER) AS topic, (SELECT count(DISTINCT word) FROM kept) AS terms,
       CAST(1.0 AS DOUBLE) AS mass
FROM range(1, 6) t(topic)"""),
        "topic_table_posterior_mass": _with(*base, select="""
SELECT docid, CAST(5 AS BIGINT) AS topics, CAST(1.0 AS DOUBLE) AS mass
FROM (SELECT DISTINCT docid FROM kept)"""),
        "classifier_reloaded": """
SELECT conv_id || '-' || turn AS docid, true AS tf_idf, true AS presence FROM conversations""",
        "history_epochs": """
SELECT CAST(e.epoch AS INTEGER) AS epoch, d.data, CAST(2 AS BIGINT) AS metrics
FROM range(1, 21) e(epoch), (VALUES ('training'), ('validation')) d(data)""",
        "histogram": """
WITH edge AS (
  SELECT min(p_retailprice) AS lo, (max(p_retailprice) - min(p_retailprice)) / 10 AS width FROM part),
placed AS (
  SELECT CAST(least(greatest(ceil((p_retailprice - lo) / width), 1), 10) AS INTEGER) AS bin
  FROM part, edge),
bins AS (SELECT CAST(b AS INTEGER) AS bin FROM range(1, 11) r(b))
SELECT b.bin, round(lo + (b.bin - 1) * width, 6) AS lower, round(lo + b.bin * width, 6) AS upper,
       (SELECT count(*) FROM placed p WHERE p.bin = b.bin) AS n
FROM bins b, edge""",
    }
