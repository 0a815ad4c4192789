from __future__ import annotations

import hashlib
import random
import re

from helpers import edge_docs, edge_rows, empty_docs

from topicspan.llm.line_dedup import dedup_lines

NO_DOC = -(2**63)


def by_hand(rows, min_docs=3, min_chars=20):
    def key(line):
        return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(
            str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        )

    holders = {}
    for doc, text in rows:
        d = NO_DOC if doc is None else doc
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(d)
    out = []
    for doc, text in rows:
        d = NO_DOC if doc is None else doc
        lines = (text or "").split("\n")
        kept = [
            l for l in lines
            if not (len(key(l)) >= min_chars and len(holders[key(l)]) >= min_docs and max(holders[key(l)]) != d)
        ]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(docs, **kw):
    rows = dedup_lines(docs, **kw).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    return sorted((tuple(r) for r in rows), key=repr)


def corpus(seed=7, n=60):
    rng = random.Random(seed)
    shared = [f"Shared line number {i} of the boilerplate" for i in range(8)]
    rows = []
    for d in range(n):
        lines = []
        for _ in range(rng.randrange(0, 9)):
            r = rng.random()
            if r < 0.4:
                lines.append(rng.choice(shared))
            elif r < 0.5:
                lines.append("  " + rng.choice(shared).upper() + " \t")
            elif r < 0.6:
                lines.append("short")
            else:
                lines.append(" ".join(rng.choice("abcde") * rng.randrange(1, 6) for _ in range(6)))
        rows.append((d * 3 + 1, "\n".join(lines)))
    return rows


def test_equals_brute_force_in_one_and_in_many_batches(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = by_hand(rows)
    assert found(docs) == want
    # Batches of a few documents: many runs, several levels and compactions.
    assert found(docs, batch_docs=4, fanout=2) == want
    assert any(r[2] for r in want)


def test_edges(spark):
    rows = [(r[0], r[1]) for r in edge_rows()]
    line = "a line that is shared by many of the documents"
    rows += [(20, line), (21, line + "\n" + line), (22, "x\n" + line.upper()), (None, line)]
    docs = edge_docs(spark, [(d, t, "en", "a", 1) for d, t in rows])
    assert found(docs) == by_hand(rows)
    assert found(docs, batch_docs=3, fanout=2) == by_hand(rows)
    got = {r.doc_id: r for r in dedup_lines(docs).collect() if r.doc_id in (20, 21, 22)}
    assert got[22].kept_text == "x\n" + line.upper() and got[21].kept_text == ""
    assert found(empty_docs(spark)) == []
