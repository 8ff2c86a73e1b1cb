import itertools
import random
import zlib

from pyspark.sql import functions as F

from quern.llm import sharding as S


def test_flow_is_minimal():
    r = random.Random(1)
    for _ in range(60):
        n, m = r.randint(1, 3), r.randint(1, 3)
        supply = [r.randint(0, 3) for _ in range(n)]
        room = [r.randint(0, 4) for _ in range(m)]
        if sum(supply) > sum(room):
            continue
        price = [[r.randint(0, 5) for _ in range(m)] for _ in range(n)]
        got = S.min_cost_flow(supply, room, lambda i, j: price[i][j])
        units = [i for i in range(n) for _ in range(supply[i])]
        best = min((sum(price[i][j] for i, j in zip(units, to)) for to in itertools.product(range(m), repeat=len(units)) if all(to.count(j) <= room[j] for j in range(m))), default=0)
        assert sum(price[i][j] * f for (i, j), f in got.items()) == best
        assert all(sum(f for (a, _), f in got.items() if a == i) == supply[i] for i in range(n))


def test_near_equal_and_few_moves():
    r = random.Random(2)
    blocks = {(s, k): r.randint(1, 2000) for s in range(16) for k in range(20 + 300 * (s == 3))}
    to = S.plan_moves(blocks, 16)
    sizes = [sum(b for k, b in blocks.items() if to[k] == j) for j in range(16)]
    have = [sum(b for k, b in blocks.items() if k[0] == j) for j in range(16)]
    mean = sum(sizes) / 16
    assert max(sizes) - min(sizes) < 0.05 * mean
    moved = sum(b for k, b in blocks.items() if to[k] != k[0])
    assert moved < 1.05 * sum(max(0, h - mean) for h in have) + 16 * 2000


def test_query(spark):
    rows = [(i, None if i % 17 == 0 else "é" * (i % 90), "hot" if i % 3 else f"s{i % 11}") for i in range(900)] + [(None, "x", None), (None, "x", None), (5, "é" * 5, "hot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = S.shard_documents(docs).collect()
    assert sorted(((g["doc_id"] or -1), g["size"], g["text_crc32"]) for g in got) == sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    by = {}
    for g in got:
        by.setdefault(g["shard"], []).append(g)
    assert set(by) == set(range(16))
    for xs in by.values():
        assert sorted(x["slot"] for x in xs) == list(range(len(xs)))
    sizes = [sum(x["size"] for x in xs) for xs in by.values()]
    assert max(sizes) - min(sizes) <= 180
    assert S.shard_documents(docs.limit(0)).count() == 0


def test_rows_that_repeat_spread_evenly(spark):
    rows = [(7, "same text", "hot")] * 1000 + [(i, "same text", "x") for i in range(100)]
    got = S.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = [sum(g["size"] for g in got if g["shard"] == j) for j in range(16)]
    assert len(got) == 1100 and max(sizes) - min(sizes) <= 10


def test_reshard_of_odd_rows(spark):
    rows = [(None, 0, 5, "a"), (None, 0, 5, "a"), (3, None, None, "b"), (4, 2, -7, "c"), (5, 9, 40, "d")]
    df = spark.createDataFrame(rows, "_old int, s int, _row int, slot string")
    got = S.reshard(df, "s", "_row", 3)
    assert got.columns == ["_old", "s", "_row", "shard", "slot", "moved", "block"] and len(got.collect()) == 5
    for j in range(3):
        assert sorted(g["slot"] for g in got.collect() if g["shard"] == j) == list(range(sum(g["shard"] == j for g in got.collect())))
    assert all(g["moved"] == (g["shard"] != (g["s"] or 0)) for g in got.collect())
    assert S.reshard(df.limit(0), "s", "_row", 3).count() == 0


def files_of(path):
    return {str(f.relative_to(path)): f.read_bytes() for f in path.rglob("*.parquet")}


def test_rewrite_in_place(spark, tmp_path):
    """A heavy shard, one that is even already, one that vanishes; null and repeated keys."""
    path = tmp_path / "store"
    rows = [(i, 0, "p" * 10) for i in range(120)] + [(None, 1, "q" * 10)] * 60 + [(7, 2, "r" * 10)] * 40 + [(i, 3, "s" * 10) for i in range(20)]
    S.write_shards(spark.createDataFrame(rows, "k long, s int, _file string").coalesce(1), "s", str(path))
    before = files_of(path)
    fate = S.rewrite(spark, str(path), 4, F.length("_file"))
    assert fate == {0: True, 1: False, 2: True, 3: True}
    after = files_of(path)
    assert {f: c for f, c in after.items() if f.startswith("shard=1/")} == {f: c for f, c in before.items() if f.startswith("shard=1/")}
    back = spark.read.parquet(str(path)).collect()
    assert sorted((r["k"] or -1, r["_file"]) for r in back) == sorted((k or -1, t) for k, _, t in rows)
    assert [sum(r["shard"] == j for r in back) for j in range(4)] == [60] * 4
    assert not [f for f in path.iterdir() if f.name.startswith(("_new", "_old"))]
    fate = S.rewrite(spark, str(path), 3, F.length("_file"))  # shard 3 goes, the others share its rows
    back = spark.read.parquet(str(path)).collect()
    assert fate[3] and len(back) == 240 and {r["shard"] for r in back} == {0, 1, 2} and not (path / "shard=3").exists()
    placed = S.slots(spark, str(path), ["k"]).collect()
    for j in range(3):
        assert sorted(r["slot"] for r in placed if r["shard"] == j) == list(range(80))
    S.write_shards(spark.createDataFrame([], "k long, s int, _file string"), "s", str(tmp_path / "none"))
    assert S.rewrite(spark, str(tmp_path / "none"), 4, F.length("_file")) == {}
