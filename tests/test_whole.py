"""Core queries against brute force on tables whose ids pass every limit that queries once had."""

import hashlib
import math

import numpy as np
import pytest

from quern.plans.queries import QUERIES

DOCS, EVENTS, VECTORS = 10_240, 4_600, 620


@pytest.fixture(scope="module")
def big(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("big")
    spark.range(DOCS).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'en' ELSE 'fr' END AS lang", "id % 7 AS n_chars").write.parquet(f"{at}/documents.parquet")
    spark.range(EVENTS).selectExpr("id AS event_id", "CASE WHEN id % 6 = 0 THEN 'error' ELSE 'view' END AS event_type", "id / 8D AS value").write.parquet(f"{at}/events.parquet")
    spark.range(VECTORS).selectExpr("id AS vec_id", "transform(sequence(0, 63), i -> CAST(sin(id * 64 + i) AS FLOAT)) AS embedding", "CAST(id % 10 AS INT) AS label").write.parquet(f"{at}/embeddings.parquet")
    return str(at)


def packs():
    return [(i, "EF"[i % 2] + "NR"[i % 2] + hashlib.md5(str(i).encode()).hexdigest(), max(i % 7, 1)) for i in range(DOCS)]


def test_catalog_parse_takes_every_document(spark, big):
    got = {(r["build"], r["name"], r["size"]) for r in QUERIES["catalog_parse"](spark, big).collect()}
    assert got == {(f"20240101-00000{i // 10_000}", name, size) for i, name, size in packs() if i % 5 != 4}


def test_catalog_select_and_diff_take_every_document(spark, big):
    got = {(r["pos"], r["total"]) for r in QUERIES["catalog_select"](spark, big).collect()}
    want, total = set(), 0
    for i, _, size in packs():
        if i % 3 == 0:
            total += size
            want.add((i, total))
    assert got == {x for x in want if x[1] <= 200_000}
    desired = {(n, s) for i, n, s in packs() if i % 3}
    active = {(n, s + (i % 10 == 0)) for i, n, s in packs() if i % 2 == 0}
    diff = {(r["name"], r["size"], r["action"]) for r in QUERIES["catalog_diff"](spark, big).collect()}
    assert diff == {(*x, "keep") for x in desired & active} | {(*x, "fetch") for x in desired - active} | {(*x, "drop") for x in active - desired}


def test_events_and_vectors_are_all_taken(spark, big):
    assert tuple(QUERIES["parity_compare"](spark, big).first()) == (EVENTS, sum(i % 101 != 0 and i % 50 == 1 for i in range(EVENTS)), sum(i % 10 == 0 for i in range(EVENTS)))
    got = {tuple(r) for r in QUERIES["reverse_index_unpack"](spark, big).collect()}
    assert got == {(i, s, i * (s * 7 + 13) % 1000) for i in range(EVENTS) for s in range(4) if not (s == 3 and i % 3 == 0)}
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{big}/embeddings.parquet").collect()}
    got = {(r["vec_id"], r["i"]): r["sample"] for r in QUERIES["wav_scan"](spark, big).collect()}
    assert got == {(i, j): math.floor(x * 30000) for i, v in vectors.items() for j, x in enumerate(v)}


def test_vector_queries_ask_their_whole_set(spark, big):
    x = np.array([r["embedding"] for r in spark.read.parquet(f"{big}/embeddings.parquet").orderBy("vec_id").collect()], float)
    d = np.round(((x[:, None] - x[:32]) ** 2).sum(2), 6)
    got = {(r["query_id"], r["rank"]): (r["partition"], r["distance"]) for r in QUERIES["nearest_partitions"](spark, big).collect()}
    assert got == {(i, r + 1): (int(p), d[i, p]) for i in range(VECTORS) for r, p in enumerate(np.argsort(d[i], kind="stable")[:4])}
    got = {(r["query_id"], r["m"]): (r["least"], r["most"]) for r in QUERIES["adc_lookup"](spark, big).collect()}
    for m in range(8):
        part = ((x[:, None, m * 8 : m * 8 + 8] - x[:256, m * 8 : m * 8 + 8]) ** 2).sum(2)
        assert np.allclose([got[i, m] for i in range(VECTORS)], np.stack([part.min(1), part.max(1)], 1), atol=1e-5)
    assert len(got) == VECTORS * 8
    asked = set(range(0, VECTORS, 50))
    for name in ("inverted_list_scan", "search_candidates", "search_topk"):
        assert {r["query_id"] for r in QUERIES[name](spark, big).select("query_id").distinct().collect()} == asked


def test_results_are_not_trimmed(spark, big):
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{big}/embeddings.parquet").collect()}
    got = {(r["vec_id"], r["i"]): r["x"] for r in QUERIES["embedding_norms"](spark, big).collect()}
    assert len(got) == VECTORS * 64
    assert all(abs(got[i, j] - x) < 2e-6 for i, v in rows.items() for j, x in enumerate(v / np.linalg.norm(v)))
    keys = ["capture_id", "shard", "track_id"]
    listed = {tuple(r) for r in QUERIES["shortlist"](spark, big).select(*keys).collect()}
    aligned = {tuple(r) for r in QUERIES["alignments"](spark, big).select(*keys).distinct().collect()}
    assert aligned == listed and any(c not in (t, 100) for c, _, t in aligned)
