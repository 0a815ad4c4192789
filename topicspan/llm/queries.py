"""The queries of the operators on training data, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspan.llm.common import short_batches, table, word_count
from topicspan.llm.quality_sql import quality_sql
from topicspan.llm.secrets_sql import secrets_sql

Query = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
        short_batches(spark)
        return fn(spark, sf_dir)

    REGISTRY[fn.__name__] = prepared
    return fn


@query
def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicspan.llm.mixing import mix

    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("id"), "source", word_count(F.col("text")).alias("size"))
    mixed = mix(rows)
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source")


ORACLES["op1_source_mix"] = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k
  FROM d GROUP BY source
), w AS (
  SELECT source, source_size, 2 * source_size AS ceiling,
         CASE k % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM s
), f AS (
  SELECT *, ceiling::DOUBLE / weight AS ratio,
         coalesce(sum(ceiling) OVER before, 0)::BIGINT AS full_before,
         coalesce(sum(weight) OVER before, 0)::BIGINT AS weight_before,
         1.5::DOUBLE * (SELECT sum(source_size) FROM w)::DOUBLE AS handed,
         (SELECT sum(weight) FROM w)::BIGINT AS weights
  FROM w
  WINDOW before AS (
    ORDER BY ceiling::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING
  )
), l AS (
  SELECT *, (handed - full_before) / (weights - weight_before) AS level FROM f
), t AS (
  SELECT source, source_size,
         coalesce(least(ceiling::DOUBLE,
                        (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, weight_before LIMIT 1) * weight),
                  ceiling::DOUBLE) AS target
  FROM l
), b AS (
  SELECT *, floor(target + 0.5)::BIGINT AS budget,
         CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs
  FROM t
), p AS (
  SELECT *, coalesce(sum(size) OVER (
           PARTITION BY source
           ORDER BY md5('42:' || coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS done
  FROM d
)
SELECT p.doc_id, p.size, b.source_size, b.target,
       (b.epochs * p.size + greatest(0, least(b.budget - b.epochs * b.source_size - p.done, p.size)))::BIGINT AS taken,
       p.source
FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source
"""


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from topicspan.llm.token_counts import count_tokens

    docs = table(spark, sf_dir, "documents")
    return count_tokens(docs, F.col("text"), path("piece_bpe_32k.model"), [F.col("doc_id")])


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicspan.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


@query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicspan.llm.secrets import described, scan_secrets

    docs = table(spark, sf_dir, "documents")
    found = scan_secrets(docs, [F.col("doc_id")], F.col("text"))
    kinds = F.transform("base", lambda s: s.kind)
    of_kind = [F.size(F.filter(kinds, F.lit(k).__eq__)).cast("long") for k in range(3)]
    return found.select(
        "doc_id",
        of_kind[0].alias("n_assign"),
        of_kind[1].alias("n_access"),
        of_kind[2].alias("n_hex"),
        F.sha2(described(F.col("base")), 256).alias("base_sha256"),
        described(F.col("spans")).alias("spans"),
    )


ORACLES["op6_quality_rules"] = quality_sql()
ORACLES["op9_secret_scan"] = secrets_sql()


@query
def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicspan.llm.topk import integers, top_k, usable

    rows = table(spark, sf_dir, "embeddings").where(usable(F.col("embedding")))
    vectors = rows.select("vec_id", integers(F.col("embedding")).alias("vector"))
    return top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


ORACLES["op4_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, vec_id, score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicspan.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from topicspan.llm.packing import packed_documents

    return packed_documents(table(spark, sf_dir, "documents"), path("word_bpe_49k.json"))


@query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicspan.llm.quality_lm import classify

    judged = classify(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"]
    )
    return judged.select("row.doc_id", F.round("perplexity", 6).alias("perplexity"), "kept")


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@query
def op7_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicspan.llm.suffix_dedup import without_repeats

    return without_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query
def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicspan.llm.pii import with_surrogates

    docs = table(spark, sf_dir, "documents")
    done = with_surrogates(docs, [F.col("doc_id")], F.col("text"))
    spans = F.transform("entities", lambda e: F.concat_ws(":", e.kind, e.start, e.end))
    return done.select(
        "doc_id",
        F.size("entities").cast("long").alias("n_entities"),
        F.array_join(spans, ",").alias("entities"),
        F.col("__text").alias("text"),
    )


@query
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicspan.llm.line_dedup import dedup_lines

    done = dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", "kept_sha256")


ORACLES["op13_line_dedup"] = r"""
WITH l AS MATERIALIZED (
  SELECT d.rid, d.doc_id, u.line, u.i
  FROM (SELECT *, row_number() OVER () AS rid FROM documents) d,
       LATERAL (SELECT unnest(string_split(coalesce(d.text, ''), chr(10))) AS line,
                       generate_subscripts(string_split(coalesce(d.text, ''), chr(10)), 1) AS i) u
), k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key, count(DISTINCT coalesce(doc_id, -9223372036854775808)) AS n_docs,
         max(coalesce(doc_id, -9223372036854775808)) AS top_doc
  FROM k WHERE length(key) >= 20 GROUP BY key
), m AS (
  SELECT k.rid, k.doc_id, k.i, k.line,
         (c.key IS NOT NULL AND c.n_docs >= 3
          AND coalesce(k.doc_id, -9223372036854775808) <> c.top_doc) AS gone
  FROM k LEFT JOIN c ON k.key = c.key AND length(k.key) >= 20
)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id
"""


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicspan.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


@query
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicspan.llm.prefix_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))
