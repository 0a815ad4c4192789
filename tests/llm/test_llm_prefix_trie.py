from __future__ import annotations

import hashlib
import random
import zlib

from topicspan.llm.prefix_trie import block_starts, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, extra string"


def by_hand(rows):
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn if turn is not None else 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(ts)] for c, ts in convs.items()}
    paths = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = own.get(c - c % 100, []) if c >= 0 else own.get(c - (abs(c) % 100) * -1, [])
        paths[c] = tuple(base[:h] + ts[h:])
    nodes = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes.setdefault(p[:d], []).append(c)
    out = []
    for prefix, members in nodes.items():
        d = len(prefix)
        kids = [q for q in nodes if len(q) == d + 1 and q[:d] == prefix]
        sub = [q for q in nodes if q[:d] == prefix]
        leaves = sum(1 for q in sub if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in nodes))
        saved = sum((len(nodes[q]) - 1) * (len(q[-1][1]) if q else 0) for q in sub)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(paths[c]) == d))
        parent = min(nodes[prefix[:-1]]) if d else None
        out.append((min(members), d, parent, len(members), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df, **kw):
    return sorted((tuple(r) for r in prefix_trie(df, **kw).collect()), key=repr)


def conversations(seed=5, n=70):
    rng = random.Random(seed)
    rows = []
    ids = [rng.choice([0, 100, 200, 300]) + rng.randrange(0, 5) for _ in range(n)] + [0, 100, 300, 301, 302]
    for c in sorted(set(ids)):
        for t in range(rng.choice([0, 1, 2, 3, 5, 9, 14, 30])):
            role = rng.choice(["user", "assistant", None])
            text = rng.choice(["hi", "hello there", "ok", None, "", "thanks a lot", "é 𠮷"])
            rows.append((c, t if rng.random() > 0.05 else None, role, text, "x"))
        if rng.random() < 0.1:
            rows.append((c, None, None, None, "y"))
    return rows


def test_equals_brute_force(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA)
    want = by_hand(rows)
    assert found(df) == want
    # Narrow blocks: conversations cross several of them.
    assert found(df, first_width=2) == want


def test_edges(spark):
    rows = [
        (None, 1, "user", "lost", "x"),
        (7, 1, "user", "same", "x"),
        (7, 1, "user", "same", "x"),  # repeated row: two equal turns
        (8, None, None, None, "x"),
        (9, 2, "user", "b", "x"),
        (9, 2, "assistant", "a", "x"),  # tie on turn
        (107, 0, "user", "own", "x"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df) == by_hand(rows)
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_blocks_cover_every_depth():
    starts = block_starts(400)
    assert starts[0] == (0, 8) and starts[-1][0] + starts[-1][1] >= 400
    assert all(w <= 60 for _, w in starts)
