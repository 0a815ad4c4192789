from __future__ import annotations

import random

from helpers import edge_docs, edge_rows, empty_docs, prose

from topicspan.llm.components import components
from topicspan.llm.minhash import near_duplicates, shingle_set


def by_hand(rows):
    """Smallest id reachable, for rows (id, text) with an id."""
    sets = []
    for i, t in rows:
        words = (t or "").encode().lower().split()
        n = max(1, len(words) - 4)
        sets.append((i, {tuple(words[k : k + 5]) for k in range(n)} if words else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, (_, a) in enumerate(sets):
        for y in range(x):
            b = sets[y][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(x)] = find(y)
    lowest = {}
    for x, (i, _) in enumerate(sets):
        lowest[find(x)] = min(i, lowest.get(find(x), i))
    return [(i, len(s), lowest[find(x)]) for x, (i, s) in enumerate(sets)]


def found(docs):
    return sorted(tuple(r) for r in near_duplicates(docs).where("doc_id IS NOT NULL").select("doc_id", "n_shingles", "component_id").collect())


def changed(rng, text, times):
    words = text.split()
    for _ in range(times):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_equals_comparing_all(spark):
    rng = random.Random(8)
    texts = [prose(i, rng.choice([1, 3, 4, 5, 6, 30, 200])) for i in range(40)]
    base = prose(99, 260)
    texts += [changed(rng, base, rng.choice([1, 2, 4, 6, 7, 8])) for _ in range(120)]  # around the bound
    texts += [base] * 20 + [base.upper()] * 3
    passage = prose(98, 60)
    texts += [passage + " " + prose(1000 + i, rng.choice([20, 40])) for i in range(60)]
    step = prose(97, 300).split()
    texts += [" ".join(step[10 * i : 10 * i + 120]) for i in range(18)]  # a chain
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert found(docs) == sorted(by_hand(rows))


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 180)] + [(7, 7)] + [(200 + rng.randrange(50), 200 + rng.randrange(50)) for _ in range(40)]
    root = {x: x for p in links for x in p}
    for _ in range(len(root)):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: root[x] for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingles():
    assert len(shingle_set("")) == len(shingle_set(" \n")) == 0
    assert len(shingle_set("a b")) == 1 and (shingle_set("A\tB") == shingle_set("a  b")).all()
    assert len(shingle_set("a b c d e f g")) == 3
    assert (shingle_set("É a") != shingle_set("é a")).all()


def test_edges(spark):
    rows = [(r[0], r[1]) for r in edge_rows() if r[0] is not None]
    docs = edge_docs(spark)
    assert found(docs) == sorted(by_hand(rows))
    out = near_duplicates(docs).collect()
    assert len(out) == docs.count()
    assert all(r["kept"] and r["component_id"] is None for r in out if r["doc_id"] is None)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out if r["doc_id"] is not None)
    assert near_duplicates(empty_docs(spark)).count() == 0
