from __future__ import annotations

import re

import pytest
from helpers import edge_docs, empty_docs
from pyspark.sql import functions as F

from topicspan.llm.pii import NAMES, with_surrogates

TEXT = (
    "Call +1 (555) 123-4567 or +1 555 123 4567, write Jane.Doe9@Mail.example.com, or jane.doe9@mail.example.com. "
    "Card 4785380592391139 and 4785-3805-9239-1139 from 10.20.30.4. Mr. Smith met Mrs Smith, MR, and Mr Smith; "
    "Господин Иванов и Госпожа Иванова. SSN 123-45-6789. No: 1.2.3 or 12345."
)


def done(spark, texts, **settings):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(with_surrogates(docs, [F.col("doc_id")], F.col("text"), **settings).collect())


def pairs(row, text):
    """(kind, old, new) of every entity: what lies between has not changed."""
    pattern, at = "", 0
    for e in row["entities"]:
        pattern += re.escape(text[at : e["start"]]) + "(.+?)"
        at = e["end"]
    new = re.fullmatch(pattern + re.escape(text[at:]), row["__text"], re.DOTALL)
    return [(e["kind"], text[e["start"] : e["end"]], n) for e, n in zip(row["entities"], new.groups(), strict=True)]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(re.sub(r"\D", "", digits))):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def test_types_formats_and_coreference(spark):
    (row,) = done(spark, [TEXT])
    found = pairs(row, TEXT)
    kinds = [k for k, _, _ in found]
    assert kinds == ["phone"] * 2 + ["email"] * 2 + ["card"] * 2 + ["ip"] + ["name"] * 5 + ["ssn"]
    by = dict(zip([v for _, v, _ in found], [n for _, _, n in found], strict=True))
    digits = lambda s: re.sub(r"\D", "", s)
    assert digits(by["+1 (555) 123-4567"]) == digits(by["+1 555 123 4567"]) != "15551234567"
    assert by["Jane.Doe9@Mail.example.com"] == by["jane.doe9@mail.example.com"]
    assert re.fullmatch(r"[a-z]{4}\.[a-z]{3}\d@[a-z]{4}\.[a-z]{7}\.com", by["jane.doe9@mail.example.com"])
    assert digits(by["4785380592391139"]) == digits(by["4785-3805-9239-1139"])
    assert luhn(by["4785380592391139"]) and by["4785380592391139"][0] == "4"
    assert all(0 < int(x) < 256 for x in by["10.20.30.4"].split("."))
    assert by["Mr. Smith"].removeprefix("Mr. ") == by["Mr Smith"].removeprefix("Mr ")
    assert by["Mr. Smith"].endswith("n") and by["Mrs Smith"].endswith("na")
    assert re.fullmatch(r"Господин [А-Я][а-я]+н", by["Господин Иванов"])
    assert re.fullmatch(r"Госпожа [А-Я][а-я]+на", by["Госпожа Иванова"])
    for kind, old, new in found:
        assert old != new
        if kind in ("phone", "card", "ssn"):
            assert re.sub(r"\d", "9", old) == re.sub(r"\d", "9", new)


def test_key_and_text_decide(spark):
    one, two = done(spark, [TEXT, "x " + TEXT])
    assert two["__text"] == "x " + one["__text"]
    (other,) = done(spark, [TEXT], key="another")
    assert other["__text"] != one["__text"]


def test_distinct_entities_stay_distinct(spark):
    # 500 addresses of one-digit parts share 6,561 surrogates: many first hashes collide.
    addresses = [f"{a}.{b}.{c}.1" for a in range(1, 10) for b in range(1, 8) for c in range(1, 9)]
    rows = done(spark, [f"at {a}, then" for a in addresses])
    given = [r["__text"][3:].split(",")[0] for r in rows]
    assert len(set(given)) == len(addresses)
    assert not set(given) & set(addresses)
    assert all(re.fullmatch(r"\d+\.\d+\.\d+\.\d+", g) for g in given)


def test_one_entity_in_a_third_of_all_rows(spark):
    rows = done(spark, [f"{i} from 10.0.0.1 and 10.0.{i % 200}.7" for i in range(300)])
    assert len({r["__text"].split(" ")[2] for r in rows}) == 1


def test_edges(spark):
    docs = edge_docs(spark)
    out = with_surrogates(docs, [F.col("doc_id"), F.col("text").alias("before"), F.col("row")], F.col("text")).collect()
    assert len(out) == docs.count()
    for r in out:
        assert r["__text"] == r["before"] and r["entities"] == []
    assert with_surrogates(empty_docs(spark), [F.col("doc_id")], F.col("text")).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    plan = with_surrogates(docs, [F.col("doc_id")], F.col("text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("script", NAMES)
def test_syllables_belong_to_their_script(script):
    pattern = {"cyrillic": "[а-я]+", "greek": "[α-ω]+", "latin": "[a-z]+"}[script]
    _, syllables, male, female = NAMES[script]
    assert all(re.fullmatch(pattern, s) for s in (*syllables, male, female))
