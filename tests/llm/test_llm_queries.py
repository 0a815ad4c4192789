"""The registered queries: SQL where it can express them, and the pipeline stage by stage."""

from __future__ import annotations

import random

import duckdb
import pytest
from helpers import edge_docs, empty_docs
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from topicspan.llm.common import stored, table, word_count
from topicspan.llm.queries import ORACLES, REGISTRY


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in ("documents", "embeddings"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, sf_dir, name):
    ours, theirs = REGISTRY[name](spark, sf_dir).toPandas(), duck.execute(ORACLES[name]).df()
    columns = sorted(theirs.columns)
    assert sorted(ours.columns) == columns
    one, two = (sorted(map(repr, df[columns].itertuples(index=False, name=None))) for df in (ours, theirs))
    assert one == two and one


def test_all_are_registered():
    names = set(contract.queries())
    assert {n for n in REGISTRY} <= names
    assert {int(n[2:].split("_")[0]) for n in REGISTRY if n.startswith("op")} == set(range(1, 14))


def test_pipeline_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = table(spark, sf_dir, "labels").collect()
    labels = {r["doc_id"]: r["quality"] for r in rows}
    # Trusted: good quality and not toxic. Toxic documents are to be caught,
    # whatever their quality label says.
    trusted = {r["doc_id"] for r in rows if r["quality"] == 1 and r["toxic"] == 0}
    good_id = min(trusted)
    like = docs.where(F.col("doc_id") == good_id).first().asDict()
    words = like["text"].split()
    random.Random(1).shuffle(words)
    like |= {"doc_id": 10**9, "text": " ".join(words) + ' token = "0123456789abcdef0123456789abcdef" end'}
    like["n_chars"] = len(like["text"])
    docs = docs.unionByName(spark.createDataFrame([like], docs.schema))
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(stored(stage(spark, seen[-1], sf_dir), name))
        assert seen[-1].columns == columns
    raw, good, single, masked, mixed = seen
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in seen]
    assert ids[0] >= ids[1] >= ids[2] == ids[3] >= ids[4]
    lost = ids[0] - ids[1]
    assert lost and not lost & trusted
    classes = REGISTRY["op8_near_duplicates"](spark, sf_dir).collect()
    assert single.count() == len(ids[2]) < good.count()
    assert {r["doc_id"] for r in classes if r["kept"]} & ids[1] <= ids[2]
    assert masked.where("doc_id = 1000000000").first()["text"].endswith(" [SECRET]\" end")
    assert masked.where(F.col("text").rlike("[0-9a-f]{24}")).count() == 0
    assert masked.where("n_chars <> length(text)").count() == single.where("n_chars <> length(text)").count()
    words = [d.select(F.sum(word_count(F.col("text")))).first()[0] for d in (masked, mixed)]
    assert words[1] == pytest.approx(1.5 * words[0], abs=20)
    packed = corpus_pipeline.STAGES[-1][1](spark, mixed, sf_dir)
    assert packed.select("doc_id", "piece", "start").where("start = 0").count() == mixed.count()


def test_stages_stand_edges(spark, sf_dir):
    for docs in (edge_docs(spark), empty_docs(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns
            assert out.count() <= 2 * docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= docs.count()


def test_one_of_equal_rows_stays(spark, sf_dir):
    docs = edge_docs(spark)
    out = corpus_pipeline.keep_one_of_each(spark, docs, sf_dir).select("doc_id").collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(["1", "3", "4", "5", "6", "None", "None", "8", "9"])
