import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import scalars as fn
from quern.operators import catalog, policy
from quern.operators.index import Scoring, Settings, VectorIndex
from quern.streaming import policy as streaming


@pytest.fixture(scope="module")
def index(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(size=8)], i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    return VectorIndex.from_embeddings(df, Settings(subspaces=4, words=16, partitions=5, probes=2)), df


def test_codeword_distance_is_zero_for_its_own_vector(index):
    ix, df = index
    rows = ix.reconstruct(ix.quantize(df.where("vec_id < 16"), "embedding")).collect()
    assert all(np.allclose(r["vector"], r["embedding"]) for r in rows)
    q = df.where("vec_id < 5").select(F.col("vec_id").alias("capture_id"), F.lit(0).alias("qi"), F.col("embedding").alias("q"))
    near = {r["capture_id"]: (r["partition"], r["distance"]) for r in ix.nearest_partitions(q).where("rank = 1").collect()}
    assert near == {i: (i, 0.0) for i in range(5)}


def test_search_against_numpy(index, spark):
    ix, df = index
    leaves = [r for r in ix.leaves.collect()]
    q = df.where("vec_id in (20, 33)").select(F.col("vec_id").alias("capture_id"), F.lit(0).alias("qi"), F.col("embedding").alias("q"))
    got = {(r["capture_id"], r["track_id"]): r["distance"] for r in ix.search_candidates(q).collect()}
    for row in q.collect():
        x = np.array(row["q"], float)
        probes = np.argsort(np.round(((ix.centroids - x) ** 2).sum(1), 6), kind="stable")[:2]
        want = {}
        for leaf in leaves:
            if leaf["partition"] in probes:
                v = np.concatenate([ix.codebook[m, c] for m, c in enumerate(leaf["code"])])
                d = round(float(((x - v) ** 2).sum()), 6)
                want[leaf["track_id"]] = min(d, want.get(leaf["track_id"], math.inf))
        assert {t: d for (c, t), d in got.items() if c == row["capture_id"]} == pytest.approx(want, abs=2e-6)


def test_sequences_find_their_track_and_offset(index):
    ix, df = index
    order = df.where("label = 1 and vec_id >= 16").orderBy("vec_id").limit(4).collect()
    q = df.sparkSession.createDataFrame([(7, i, r["embedding"]) for i, r in enumerate(order)], "capture_id bigint, qi int, q array<float>")
    best = ix.search_sequences(q).where("rank = 1").first()
    first = ix.leaves.where(F.col("vec_id") == order[0]["vec_id"]).first()["occurrence"]
    assert best["track_id"] == 1 and best["offset"] == first
    assert ix.search_sequences(q, 0).count() == 0 and ix.search_sequences(q.limit(0)).count() == 0
    with pytest.raises(ValueError):
        ix.biases(ix.weights(q), 0.0)


def test_continuity_ignores_what_is_not_finite(index, spark):
    ix, df = index
    row = ix.leaves.where("track_id = 2 and occurrence = 6").join(df, "vec_id").first()
    q = spark.createDataFrame([(1, 0, row["embedding"])], "capture_id bigint, qi int, q array<float>")
    before = spark.createDataFrame([(1, 0, 2, [float("nan"), 7.4, -9.0])], "capture_id bigint, shard int, track_id bigint, predicted array<double>")
    got = ix.continuity(q, before).first()
    assert 5 <= got["offset"] <= 9
    with pytest.raises(ValueError):
        VectorIndex(ix.centroids[:2], ix.codebook, ix.leaves, ix.metadata, ix.settings)
    with pytest.raises(ValueError):
        Settings(probes=0)


def test_score_trace(spark):
    """A sum of zero scores minus infinity; the finish is ln(-expm1(-u)) + u + bias."""
    rows = spark.createDataFrame([(0.0,), (0.5,), (700.0,)], "u double").select(fn.score_finish(F.col("u"), F.lit(1.0)).alias("s")).collect()
    assert rows[0]["s"] == -math.inf and rows[1]["s"] == pytest.approx(math.log(1 - math.exp(-0.5)) + 1.5) and rows[2]["s"] == pytest.approx(701)
    assert Scoring().neighbours == 200


def history(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "user_id bigint, event_id bigint, at_ms bigint, matched boolean, offset_ms bigint, duration_ms bigint")


@pytest.mark.parametrize(
    "rows, want",
    [
        ([(0, False, None, None)], 55_000),
        ([(i * 1000, False, None, None) for i in range(10)], 90_000),
        ([(0, True, 170_000, 190_000)], 20_000),
        ([(0, True, 100_000, 150_000)], 47_000),
        ([(0, True, 10_000, 300_000)], 55_000),
        ([(0, True, 10_000, None)], 55_000),
        ([(0, True, 1_000, 30_000), (1000, False, None, None)], 55_000),
        ([(i, False, None, None) for i in range(9)] + [(720_009, False, None, None)], 55_000),
    ],
)
def test_squelch_tables(spark, rows, want):
    last = policy.squelch(history(spark, rows)).orderBy(F.desc("event_id")).first()
    assert (last["squelch_ms"], last["next_delay_ms"]) == (want, want + 4000)
    events = [(r[0], i, *r[1:]) for i, r in enumerate(rows)]
    assert streaming.decide(events, rows[-1][0]) == want


def test_stream_state_ignores_future_and_expired():
    old = [(0, 1, True, 1_000, 30_000)]
    assert streaming.decide(old, 1_200_001) == 55_000 and streaming.decide([(10, 1, True, 170_000, 190_000)], 5) == 55_000


def test_projection_and_depth(spark):
    h = history(spark, [(0, True, 5_000, None), (1_000, False, None, None), (1_201_001, False, None, None)])
    got = policy.projected_previous(h).collect()
    assert [(r["event_id"], r["match_id"], r["offset_seconds"]) for r in got] == [(1, 0, 6.0)]
    e = spark.createDataFrame([(1, i, i, s) for i, s in enumerate([-1, 1, 1, -1, -1, -1, 1])], "user_id bigint, event_id bigint, at_ms bigint, step int")
    assert [r["depth"] for r in policy.on_demand_depth(e).orderBy("event_id").collect()] == [0, 1, 2, 1, 0, 0, 1]


def test_history_store(spark):
    h = spark.createDataFrame([(1, "a", 10), (2, "b", 30), (3, "c", 20)], "id bigint, track_id string, recognized_at_ms bigint")
    assert [r["id"] for r in policy.newest_first(h, 2).collect()] == [2, 3]
    assert sorted(r["id"] for r in policy.pruned(h, 10, 5).collect()) == [2, 3]
    new = policy.insert(h, h.drop("id").where("track_id = 'a'"))
    assert new.count() == 4 and new.agg(F.max("id")).first()[0] == 4
    assert policy.delete(h, 2).count() == 2


def manifest(spark, packs):
    import json

    return spark.createDataFrame([("20240101-000000", json.dumps({"packs": packs}))], "build string, document string")


def pack(**kw):
    return {"name": "AB" + "0" * 32, "size": 10, "compressed_size": 5, "download_urls": ["https://h/x"], "extra_type": "shard", "extra_country_codes": "US, gb"} | kw


def test_manifests(spark):
    rows = catalog.parse_manifests(manifest(spark, [pack(), pack(name="CD" + "1" * 32, size=20), pack(extra_type="model", name="bad")])).collect()
    assert [(r["pos"], r["country_codes"]) for r in rows] == [(0, ["us", "gb"]), (1, ["us", "gb"])]
    packs = catalog.parse_manifests(manifest(spark, [pack(), pack(name="CD" + "1" * 32, size=20), pack(name="EF" + "2" * 32, size=1)]))
    assert [r["size"] for r in catalog.select_packs(packs, "us", 10).collect()] == [10]
    assert catalog.select_packs(packs, "us", 25).count() == 1  # stops at the first that is too much
    assert catalog.select_packs(packs, "us", None).count() == 3 and catalog.select_packs(packs, "fr", None).count() == 0
    for broken in (pack(name="x"), pack(size=0), pack(size=134_217_729), pack(download_urls=[]), pack(download_urls=["http://h"]), pack(extra_country_codes=" ,"), pack(extra_country_codes="usa")):
        with pytest.raises(Exception, match="invalid manifest"):
            catalog.parse_manifests(manifest(spark, [broken])).collect()
    with pytest.raises(Exception, match="repeated name"):
        catalog.parse_manifests(manifest(spark, [pack(), pack()])).collect()
    assert catalog.parse_manifests(manifest(spark, [pack(), pack()]), strict=False).where("error is not null").count() == 2


def test_sync_plans():
    a, b, c = ("a", 1), ("b", 2), ("c", 3)
    active = {"build": "1", "country": "us", "packs": [a], "complete": False}
    assert catalog.sync_plan([a, b, c], active, "1", "us") == {"mode": "resume", "fetch": [b, c], "activations": [[a, b], [a, b, c]]}
    assert catalog.sync_plan([b, a], active, "1", "us") == {"mode": "swap", "fetch": [b], "activations": [[b, a]]}
    assert catalog.sync_plan([a], active, "1", "us")["mode"] == "complete"
    assert catalog.sync_plan([a], active | {"complete": True}, "1", "us")["mode"] == "none"
    assert catalog.sync_plan([], None, "1", "us")["activations"] == [[]]


def test_gates_and_scalars(spark):
    s = spark.createDataFrame([(0, True, None, 0, 0), (1, True, None, 0, 0), (0, None, None, 0, 0), (0, True, False, 0, 0), (0, True, True, None, 0), (0, True, True, 2, 0), (0, True, True, 0, None), (0, True, True, 0, 3)], "on_demand int, user_foreground boolean, main_user_foreground boolean, call_state int, recordings int")
    got = [r[0] for r in s.select(policy.block_reason()).collect()]
    assert got == [None, *(r for r, _ in policy.BLOCKS)]
    one = spark.range(1)
    assert one.select(fn.base_url(F.lit(" https://h.example/x// "))).first()[0] == "https://h.example/x"
    assert [one.select(fn.base_url(F.lit(u))).first()[0] for u in ("http://h/x", "https://h/x?q", "https://", "nonsense", "https://h/#f")] == [None] * 5
    assert one.select(fn.round_half_up(F.lit(-1000), 2000), F.hex(fn.record_key("M", F.lit(0x010203)))).first()[:] == (0, "4D030201")
    with pytest.raises(Exception, match="24 bits"):
        one.select(fn.record_key("M", F.lit(1 << 24))).collect()
    with pytest.raises(Exception, match="malformed"):
        one.select(fn.unpack_partitions(F.unhex(F.lit("01")))).collect()


def test_parity(spark):
    cols = "capture string, accepted boolean, track string, shard string, offset double, score double"
    a = spark.createDataFrame([("x", True, "t", "s", 1.0, 2.0), ("y", False, None, None, None, None), ("z", True, "t", "s", 1.0, 2.0)], cols)
    b = spark.createDataFrame([("x", True, "t", "s", 1.0, 2.1), ("y", False, None, None, None, None), ("z", True, "u", "s", 1.0, 2.0)], cols)
    assert catalog.parity_summary(catalog.parity(a, b)).first()[:] == (3, 1, 1)
