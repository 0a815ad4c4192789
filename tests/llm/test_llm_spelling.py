from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from helpers import edge_docs, empty_docs

from topicspan.llm import spelling
from topicspan.llm.spelling import spelling_variants

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_hand(rows):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                p = h % len(run)
                run = run[:p] + run[p + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        if vs:
            top = min(vs, key=lambda v: (-words[v], v))
            form[w] = top if words[top] >= 5 * words[w] else None
        else:
            form[w] = None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        f = form[w]
        out.append((w, f, root, words[w], len(near[w]), words[f] if f else None))
    return sorted(out)


def found(docs):
    rows = spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()
    return sorted(tuple(r) for r in rows)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    base = ["spelling", "variant", "colour", "réservé", "grammar", "receive", "definitely"]
    vocab = []
    for w in base:
        vocab += [w] * 40
        for _ in range(6):
            i = rng.randrange(len(w))
            op = rng.randrange(3)
            c = rng.choice("aeiouéx")
            v = w[:i] + c + w[i + 1 :] if op == 0 else w[:i] + c + w[i:] if op == 1 else w[:i] + w[i + 1 :]
            vocab += [v] * rng.choice([1, 5, 7, 9, 30])
    vocab += ["RECEIVE"] * 3 + ["recieve"] * 6 + ["recieved"] * 6
    rng.shuffle(vocab)
    rows = [(d, " ".join(vocab[d * 9 : d * 9 + 9]) + ", 12 x") for d in range(len(vocab) // 9 + 1)]
    rows += [(None, "colour colour"), (1000, None), (1001, ""), (1001, "")]
    want = by_hand(rows)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == want
    assert any(r[1] for r in want) and any(r[4] for r in want)  # forms and neighbours exist


def test_edges(spark):
    docs = edge_docs(spark)
    from helpers import edge_rows

    assert found(docs) == by_hand([(r[0], r[1]) for r in edge_rows()])
    assert found(empty_docs(spark)) == []


def test_no_table_of_words_is_broadcast(spark, monkeypatch):
    """exploded words were sized as one row a word, and sent through the driver."""
    plans = []
    kept = spelling.stored
    monkeypatch.setattr(
        spelling, "stored",
        lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, name),
    )
    texts = [(i, f"letter lettre letterr stamps stamp{'s' * (i % 2)} railway") for i in range(40)]
    found = spelling.spelling_variants(spark.createDataFrame(texts, "doc_id long, text string"))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert found.where("n_near > 0").count() > 0
    assert sum("SortMergeJoin" in p for p in plans) >= 3
    assert not any("Broadcast" in p for p in plans)
