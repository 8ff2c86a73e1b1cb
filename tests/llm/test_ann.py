import numpy as np
from pyspark.sql import functions as F

from quern.llm import ann as A

FEW = A.Settings(books=8, words=16, sample=512, shortlist=64, query_block=7, row_block=500)


def brute(rows, queries, k=5):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)]
    out = {}
    for q, x in ok:
        if queries(q):
            found = sorted((-float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y))), i) for i, y in ok if i != q)
            out[q] = [(i, -s) for s, i in found[:k]]
    return out


def answers(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(got[r["query_id"]]) == r["rank"]
    return got


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2500, 16)) * rng.uniform(0.1, 9, (2500, 1))
    rows = [(i, [float(np.float32(y)) for y in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = answers(A.search(df, F.col("vec_id") % 50 == 0, "vec_id", "embedding", s=FEW))
    true = brute(rows, lambda q: q % 50 == 0)
    assert got.keys() == true.keys()
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in true[q]}) for q in true) / (5 * len(true))
    assert hit >= 0.9
    all_scores = {(q, i): s for q, v in brute(rows, lambda q: q % 50 == 0, 2500).items() for i, s in v}
    assert all(abs(s - all_scores[q, i]) < 1e-12 for q, v in got.items() for i, s in v)


def test_odd_vectors_ties_and_copies(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (100, None), (8, [1.0]), (150, [1.0, 0.0])]
    rows += [(200 + i, [1.0, 0.0]) for i in range(30)] + [(9, [1.0, 1.0]), (10, [1.0, 1.0]), (9, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = answers(A.neighbour_digest(df))
    true = brute([r for r in dict.fromkeys((i, None if v is None else tuple(v)) for i, v in rows) if r[1] is None or len(r[1]) == 2], lambda q: q % 50 == 0)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in true.items()}
    assert A.neighbour_digest(df.limit(0)).count() == 0
    assert len(answers(A.neighbour_digest(df.where("vec_id in (0, 50)")))[0]) == 1
