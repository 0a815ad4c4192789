"""Every query with an SQL form equals DuckDB on the same tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as contract
from topicspan.plans.queries import REGISTRY

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


@pytest.fixture(scope="module")
def oracles(spark):
    return contract.oracle_sql()


def _sorted_rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(
        (tuple(None if v != v else v for v in row) for row in pdf.itertuples(index=False)), key=repr
    )


# Fixed list, so that a query that loses its oracle is noticed.
WITH_ORACLE = """
corpus_rows csv_roundtrip token_counts vocabulary corpus_totals frequent_tokens_preview ngram_counts
ngrams_per_topic tf_idf top_tf_idf_words corpus_with_new_texts new_text_tokens new_text_tf_idf
extended_tf_idf topic_term_table top_terms strongest_terms top_terms_page top_terms_per_topic
term_display_order log_ratio log_ratio_page log_ratio_wide term_ngrams label_candidates
label_suggestions label_suggestions_bigrams doc_topic_argmax doc_topics_ranked clustered_docs
cluster_sizes cluster_filter cluster_export related_docs default_label_table label_override
label_table_roundtrip feature_rows stratified_split class_shares one_hot_labels treatment_contrasts
binary_features test_predictions_join evaluate_predictions history_by_epoch histogram lda_vocabulary
lda_posterior_mass history_epochs classifier_reloaded topic_table_vocabulary topic_table_posterior_mass
""".split()


def test_oracles_belong_to_queries(oracles):
    ours = {name for name in oracles if name in REGISTRY}
    assert ours == set(WITH_ORACLE)
    assert set(oracles) <= set(contract.queries())


@pytest.mark.parametrize("name", WITH_ORACLE)
def test_equals_sql(spark, duck, oracles, sf_dir, name):
    ours = contract.queries()[name](spark, sf_dir).toPandas()
    theirs = duck.sql(oracles[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) == len(theirs) > 0
    assert _sorted_rows(ours) == _sorted_rows(theirs)
