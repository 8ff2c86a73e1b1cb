import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import brown as B

WORD = re.compile("[^\x20\x09-\x0d]+")


def tok(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


def corpus(seed, n=250):
    r = random.Random(seed)
    langs = [["the", "of", "And", "x%d"], ["le", "la", "et", "é%d"], ["der", "die", "y%d"]]
    rows = []
    for i in range(n):
        one = r.choice(langs)
        rows.append((i, " ".join((w % int(r.paretovariate(0.7))) if "%" in w else w for w in (r.choice(one) for _ in range(r.randint(0, 60))))))
    return rows + [(n, None), (n + 1, ""), (n + 2, "zzz " * 5000), (n + 3, "w" * 80_000)]


@pytest.mark.parametrize("settings", [B.Settings(), B.Settings(classes=4, clustered=6, head=12)])
def test_base_and_counts_match_brute_force(spark, settings):
    rows = corpus(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1).repartition(3)
    got = {r["doc_id"]: r for r in B.score_documents(docs, "h", settings).collect()}
    c = Counter(x for i, t in rows if not held(i) for x in [*tok(t), None])
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    for i, t in rows:
        x = [*tok(t), None]
        g = got[i]
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (held(i), len(x), sum(c[y] > 0 for y in x), n)
        assert g["base_score"] == pytest.approx(sum(math.log10((c[y] + 0.5) / (n + 0.5 * (v + 1))) for y in x), rel=1e-9)
        assert g["score"] < 0 and math.isfinite(g["score"])
    out = [g for i, g in got.items() if g["held_out"]]
    assert sum(g["score"] for g in out) > sum(g["base_score"] for g in out)  # better than unigrams on unseen documents


def brute(rows, h, s):
    """The model by dictionaries: log10 probability of a text, and the tables that must sum to one."""
    train = [tok(t) for i, t in rows if not h(i)]
    c = Counter(w for t in train for w in t)
    order = sorted((w for w in c if c[w] > 1 and len(w.encode()) <= s.longest), key=lambda w: (-c[w], w.encode()))
    core = order[: min(s.core, s.clustered, s.head)]
    number = {w: i for i, w in enumerate(core)} | {None: len(core)}
    pairs = np.zeros((len(core) + 1,) * 2)
    for t in train:
        for x, y in itertools.pairwise([None, *t, None]):
            if x in number and y in number:
                pairs[number[x], number[y]] += 1
    of = B.exchange(pairs, s.classes, s.rounds)
    k = s.classes + 1
    cls = {w: int(of[i]) for w, i in number.items()}
    both = np.zeros((k, k))
    near = {}
    for t in train:
        for x, y, z in zip([None, None, *t], [None, *t, None], [*t, None, None]):
            if x in cls and y in cls and (x, y) != (None, None):
                both[cls[x], cls[y]] += 1
            if y is not None and y not in cls and c[y] > 1:
                n = near.setdefault(y, np.zeros(2 * k))
                if x in cls:
                    n[cls[x]] += 1
                if z in cls:
                    n[k + cls[z]] += 1
        if t and t[-1] in cls:
            both[cls[t[-1]], k - 1] += 1
        if not t:
            both[k - 1, k - 1] += 1
    kind = dict(cls)
    for w, n in near.items():
        if n.any():
            kind[w] = int(B.choose(n[None], np.array([-1]), both)[0])
    rare = k
    total = sum(c.values()) + len(train)
    mass = np.zeros(k + 1)
    for w in c:
        mass[kind.get(w, rare)] += c[w]
    mass[k - 1] = len(train)
    once = sum(n == 1 for n in c.values()) or 0.5
    unseen = once / (mass[rare] + once)
    emit = {w: c[w] / mass[kind.get(w, rare)] * (1 - unseen if w not in kind else 1) for w in c}
    follow = np.zeros((k + 1, k + 1))
    path = lambda t: [k - 1, *(kind.get(w, rare) for w in t), k - 1]
    for t in train:
        for x, y in itertools.pairwise(path(t)):
            follow[x, y] += 1
    share = (mass + 0.5) / (mass + 0.5).sum()
    p = (follow + s.prior * share) / (follow.sum(1, keepdims=True) + s.prior)
    assert total == mass.sum()
    score = lambda t: sum(math.log10(emit.get(w, unseen)) for w in tok(t)) + sum(math.log10(p[x, y]) for x, y in itertools.pairwise(path(tok(t))))
    return score, p, {x: sum(emit[w] for w in c if kind.get(w, rare) == x) + (unseen if x == rare else 0) for x in {kind.get(w, rare) for w in c}}


@pytest.mark.parametrize("settings", [B.Settings(classes=3, core=6, clustered=6, head=9), B.Settings(classes=5, core=40, clustered=40), B.Settings(classes=2, core=0, clustered=0, head=4)])
def test_scores_match_brute_force(spark, settings):
    rows = corpus(5, 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1).repartition(3)
    docs = docs.repartition(40)  # more partitions than tasks that write
    score, follow, emit = brute(rows, held, settings)
    assert np.allclose(follow.sum(1), 1) and np.allclose(list(emit.values()), 1)  # after any class, classes; in any class, known words and unseen ones
    for r in B.score_documents(docs, "h", settings).collect():
        assert r["score"] == pytest.approx(score(dict(rows)[r["doc_id"]]), rel=1e-9)


def test_sums_in_two_steps_are_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(8, 200), "doc_id long, text string").withColumn("h", F.col("doc_id") % 5 == 1).repartition(6)
    s = B.Settings(classes=4, core=3)
    want = {r["doc_id"]: r["score"] for r in B.score_documents(docs, "h", s).collect()}
    monkeypatch.setattr(B, "FAN", 1)
    monkeypatch.setattr(B, "RANGE", 5)
    assert {r["doc_id"]: r["score"] for r in B.score_documents(docs, "h", s).collect()} == pytest.approx(want, rel=1e-9)


def test_sweeps_raise_the_likelihood(spark):
    """All words of the dictionary are exchanged, and held-out text is less surprising than with classes of the core alone."""
    r = random.Random(7)
    kinds = [[f"{one}{i}" for i in range(120)] for one in "abcdef"]
    text = lambda: " ".join(r.choice(kinds[j % 6]) for j in range(r.randint(5, 60)))
    docs = spark.createDataFrame([(i, text()) for i in range(400)], "doc_id long, text string").withColumn("h", F.col("doc_id") % 5 == 1).repartition(4)
    total = lambda s: sum(x["score"] for x in B.score_documents(docs, "h", s).where("held_out").collect())
    assert total(B.Settings(classes=6, core=60)) > total(B.Settings(classes=6, core=60, sweeps=0)) + 100


def test_gains_are_changes_of_the_likelihood():
    r = np.random.default_rng(3)
    both = r.integers(0, 50, (5, 5)).astype(float)
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)
    value = lambda b: f(b).sum() - f(b.sum(1)).sum() - f(b.sum(0)).sum()
    near = r.integers(0, 6, (1, 10)).astype(float)
    got = B.gains(near, np.array([-1]), both)[0]
    for b in range(4):
        more = both.copy()
        more[:, b] += near[0, :5]
        more[b] += near[0, 5:]
        # margins apart, for the neighbours' own margins rise alike in every class
        apart = f(both[:, b] + near[0, :5]).sum() - f(both[:, b]).sum() + f(both[b] + near[0, 5:]).sum() - f(both[b]).sum() - f(both[b].sum() + near[0, 5:].sum()) + f(both[b].sum()) - f(both[:, b].sum() + near[0, :5].sum()) + f(both[:, b].sum())
        assert got[b] == pytest.approx(float(apart))
    assert np.isfinite(value(both))


def test_exchange_finds_the_best_split():
    r = np.random.default_rng(1)
    groups = [[0, 1, 2], [3, 4, 5]]
    pairs = np.zeros((7, 7))
    for a, b in itertools.product(range(6), repeat=2):
        pairs[a, b] = 40 + r.integers(5) if (a < 3) != (b < 3) else r.integers(3)
    pairs[6, :6] = pairs[:6, 6] = 1
    of = B.exchange(pairs, 2, 20)
    assert [len({of[i] for i in g}) for g in groups] == [1, 1] and of[0] != of[3] and of[6] == 2


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string").withColumn("score", F.lit("mine"))
    assert B.lm_digest(docs).count() == 3
    assert B.lm_digest(docs.limit(0)).count() == 0
    nothing = B.score_documents(docs.withColumn("h", F.lit(True)), "h").collect()
    assert all(r["base_score"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in nothing)


def test_the_dictionary_bounds_no_class(spark):
    """Words beyond the dictionary have the classes, and so the scores, that they have within it."""
    docs = spark.createDataFrame(corpus(3), "doc_id long, text string").withColumn("h", F.col("doc_id") % 5 == 1).repartition(3)
    few, all_ = ({r["doc_id"]: r for r in B.score_documents(docs, "h", B.Settings(classes=4, clustered=6, head=head)).collect()} for head in (8, 100_000))
    assert len(few) == len(all_) == 254
    for i, r in all_.items():
        assert few[i]["score"] == pytest.approx(r["score"], rel=1e-9) and few[i]["n_known"] == r["n_known"]
