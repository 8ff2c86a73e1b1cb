import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import linking, neardup as N
from quern.llm import words as W
from quern.llm.components import connected


def sets(text, k):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k=4, percent=80):
    s = [sets(t, k) for _, t in rows]
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if s[a] and s[b]:
                both = len(s[a] & s[b])
                if 100 * both >= percent * (len(s[a]) + len(s[b]) - both):
                    x, y = find(rows[a][0]), find(rows[b][0])
                    up[max(x, y)] = min(x, y)
    return {i: (len(s[n]), find(i), find(i) == i) for n, (i, _) in enumerate(rows)}


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["Ünï", "WORD"]
    rows, base = [], []
    for _ in range(25):
        base.append([r.choice(vocab) for _ in range(r.choice([1, 3, 4, 5, 9, 30, 120, 500]))])
    passage = [r.choice(vocab) for _ in range(60)]
    for i in range(330):
        w = list(r.choice(base)) if i % 2 else [r.choice(vocab) for _ in range(r.randint(0, 60))]
        for _ in range(r.choice([0, 0, 1, 2, max(1, len(w) // 40)])):
            if w:
                w[r.randrange(len(w))] = r.choice(vocab)
        if i % 7 == 0:
            w = passage + w[:20]
        rows.append((i * 3 + 1, r.choice([" ", "\n", "  "]).join(w)))
    hub = [r.choice(vocab) for _ in range(200)]
    for i in range(60):  # near the hub but mostly not to one another
        w = list(hub)
        for at in r.sample(range(200), 4):
            w[at] = r.choice(vocab)
        rows.append((2000 + i, " ".join(w)))
    return rows + [(1500, " ".join(hub)), (5000, None), (5001, ""), (5002, " \n "), (5003, "x" * 100_000), (5004, "a " * 40_000)]


@pytest.mark.parametrize("block", [1024, 8])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(linking, "BLOCK", block)
    rows = corpus(block)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component", F.lit("mine"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in N.near_duplicates(docs, 4).collect()}
    assert got == brute(rows)


def test_edges(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in N.near_duplicates(docs, 4).collect())
    assert got == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    assert N.drop_near_duplicates(docs).count() == 4
    assert N.near_duplicates(docs.limit(0)).count() == 0


def test_estimates_are_close():
    r = np.random.default_rng(1)
    errors = []
    for share in (0.3, 0.8, 0.95):
        for n in (60, 2000, 50_000):
            both = int(n * share)
            a = r.integers(0, 2**63, n).astype(W.U)
            b = np.concatenate([a[:both], r.integers(0, 2**63, n - both).astype(W.U)])
            s = N.sketch(np.concatenate([a, b]), np.array([0, n, 2 * n]))
            est, used = N.estimate(s[:1], np.array([n]), s[1:], np.array([n]))
            errors.append((est[0] - both / (2 * n - both)) / np.sqrt(0.25 / used[0]))
    assert np.abs(errors).max() < 3.5
    assert (N.chance_collisions(np.array([10, 1000, 10**6]), np.array([10, 1000, 10**6])) < 0.002).all()


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {x["node"]: x["component"] for x in connected(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in up if any(x in e and e[0] != e[1] and None not in e for e in edges)}


def test_every_text_of_an_id_is_linked(spark):
    a, b = ("one two three four five six seven eight nine ten".split(), "red blue green white black brown grey pink gold teal".split())
    rows = [(1, " ".join(a)), (1, " ".join(b)), (1, ""), (2, " ".join([*b, *b[:1]])), (3, " ".join([*a, *a[:1]])), (4, " ".join(reversed(a))), (5, ""), (6, None), (6, " ".join(a))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(0), "d": F.lit(0), "_id": F.lit(0)})
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in N.near_duplicates(docs, 4).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (5, 5, True), (6, 1, False)}
    left = N.drop_near_duplicates(docs, 4)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 1, 1, 4, 5]


def test_regular_words_are_told_apart(spark):
    s = [0]
    for _ in range(11):
        s += [1 - v for v in s]
    words = ["".join("ab"[v] for v in s), "".join("ba"[v] for v in s)]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    assert all(r["kept"] for r in N.near_duplicates(docs, 4).collect())


def test_hot_nodes_are_dealt_to_several_tasks(spark, monkeypatch):
    from quern.llm import components

    monkeypatch.setattr(components, "HOT", 8)
    monkeypatch.setattr(components, "CHUNK", 16)
    edges = [(7, i) for i in range(20, 120)] + [(7, 3), (i := 500, 119), (500, 501), (90, 91)] + [(3000 + i, 3001 + i) for i in range(40)]
    got = {x["node"]: x["component"] for x in connected(spark.createDataFrame(edges, "a long, b long").repartition(5), "a", "b").collect()}
    assert got == {n: 3 if n < 3000 else 3000 for e in edges for n in e}
