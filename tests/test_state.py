import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import audio as A
from quern.functions import scalars as fn
from quern.operators import catalog, policy, state
from quern.sources import codecs as C
from quern.sources import tables as T
from quern.streaming import policy as S

NAME = "GB" + "0" * 31


def document(**other):
    base = {"build": "20240101-000000", "country": "gb", "packs": [{"name": NAME + "1", "size": 5}], "complete": True}
    return json.dumps({**base, **other})


def test_active_documents(spark):
    packs = [{"name": NAME + "1", "size": 5}]
    good = [document(), document(packs=[]), json.dumps({"build": "20240101-000000", "country": "gb", "packs": packs})]
    bad = [None, "", "{", document(build="x"), document(country="GB"), document(packs=packs * 2), document(packs=[{"name": "x", "size": 5}]), document(packs=[{"name": NAME + "1", "size": 0}]), document(packs=[{"name": NAME + "1"}]), document(extra="x" * 1_100_000), '{"build":"20240101-000000","country":"gb"}']
    rows = spark.createDataFrame(list(enumerate(good + bad)), "store long, document string")
    objects = spark.createDataFrame([(i, NAME + "1", 5) for i in range(len(good + bad)) if i != 2], "store long, name string, size long")
    parsed = {r["store"]: r["a"] for r in rows.select("store", state.parse_active(F.col("document")).alias("a")).collect()}
    assert [parsed[i] is not None for i in range(len(good + bad))] == [True] * 3 + [False] * len(bad)
    assert parsed[2]["complete"] is False
    got = {r["store"]: tuple(r)[1:] for r in state.catalog_state(state.read_active(rows, objects)).collect()}
    assert got[0] == ("20240101-000000", "gb", 1, 5, True) and got[1][2:] == (0, 0, True)
    assert all(got[i] == (None, None, 0, 0, False) for i in range(2, len(good + bad)))


def test_activation_raises_or_says_so(spark):
    wanted = spark.createDataFrame([(1, "20240101-000000", "gb", [(NAME + "1", 5)], True)], "store long, build string, country string, packs array<struct<name:string,size:long>>, complete boolean")
    none = spark.createDataFrame([(1, NAME + "1", 6)], "store long, name string, size long")
    with pytest.raises(Exception, match="missing or truncated"):
        state.activate(wanted, none).collect()
    assert state.activate(wanted, none, strict=False).first()["document"] is None
    done = state.activate(wanted, none.withColumn("size", F.lit(5))).first()["document"]
    assert json.loads(done) == {"build": "20240101-000000", "country": "gb", "packs": [{"name": NAME + "1", "size": 5}], "complete": True}


def test_documents_are_replaced(spark, tmp_path):
    rows = spark.createDataFrame([("a",), ("b",)], "document string")
    for n in (2, 1):
        state.write_active(rows.limit(n), str(tmp_path / "active"))
        assert spark.read.text(str(tmp_path / "active")).count() == n and not (tmp_path / "active.partial").exists()


def test_a_broken_manifest_raises_for_every_column(spark):
    pack = {"name": NAME + "1", "size": -5, "compressed_size": 1, "download_urls": ["https://h/x"], "extra_type": "shard", "extra_country_codes": "gb"}
    rows = spark.createDataFrame([("20240101-000000", json.dumps({"packs": [pack]}))], "build string, document string")
    for read in (lambda d: d.select("size").collect(), lambda d: d.count(), lambda d: d.select("name").collect()):
        with pytest.raises(Exception, match="invalid manifest: size"):
            read(catalog.parse_manifests(rows))
    assert catalog.parse_manifests(rows, strict=False).first()["error"] == "size"


def test_history_table(spark):
    row = (1, "t", "a", "id", "S", 2, 1.5, 0.5, 10)
    good = spark.createDataFrame([row], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.HISTORY))
    assert tuple(state.history_table(good).first()) == row
    with pytest.raises(Exception, match="null in artist"):
        state.history_table(good.withColumn("artist", F.lit(None).cast("string"))).collect()
    rest, gone = policy.remove(good, 1)
    assert rest.count() == 0 and gone.first()["gone"] == 1
    rest, gone = policy.clear(good)
    assert rest.count() == 0 and rest.columns == good.columns and gone.first()["gone"] == 1


def test_insert_numbers_in_order_of_time(spark):
    h = spark.createDataFrame([(4, "x", 1)], "id bigint, track_id string, recognized_at_ms bigint")
    new = spark.createDataFrame([(f"t{i % 3}", (i * 7919) % 1000) for i in range(300)], "track_id string, recognized_at_ms bigint")
    got = [(r["id"], r["recognized_at_ms"], r["track_id"]) for r in policy.insert(h, new, fan=7).where("id > 4").orderBy("id").collect()]
    assert [g[0] for g in got] == list(range(5, 305)) and [g[1:] for g in got] == sorted(g[1:] for g in got)
    assert policy.insert(h, new.limit(0)).count() == 1


def test_results_and_entries(spark):
    match = F.struct(F.lit('q"\\\n\u0002').alias("title"), F.lit("a"), F.lit("t"), F.lit(3), F.lit("S"), F.lit(1.25), F.lit(7), F.lit(None).cast("double"))
    text = spark.range(1).select(state.result_document(F.lit(None), F.lit(None), match).alias("d")).first()["d"]
    assert json.loads(text) == {"musicScore": None, "continuity": None, "match": {"title": 'q"\\\n\u0002', "artist": "a", "trackId": "t", "numericId": 3, "shard": "S", "score": 1.25, "offset": 7, "duration": None}}
    docs = spark.createDataFrame([(text,), ("{",), (None,)], "d string")
    got = [r["r"] for r in docs.select(state.parse_result(F.col("d")).alias("r")).collect()]
    assert got[0]["match"]["title"] == 'q"\\\n\u0002' and got[0]["musicScore"] is None and got[2] is None
    texts = spark.createDataFrame([('[{"at_ms":1,"matched":true,"offsets_ms":[3,9]}]',), ("[{",), (None,), ("[]",)], "d string")
    assert [len(r["e"]) for r in texts.select(state.parse_entries(F.col("d")).alias("e")).collect()] == [1, 0, 0, 0]


def test_scalars(spark):
    minute = 60_000
    rows = spark.createDataFrame([(0, 59_999), (0, 5 * minute), (10, 0), (0, 60 * minute)], "t long, n long")
    assert [r[0] for r in rows.select(fn.minutes_ago(F.col("t"), F.col("n"))).collect()] == ["now", "5 min", "now", "1970-01-01 00:00"]
    assert [r[0] for r in rows.select(policy.rearm_delay(F.col("n"), F.lit(60_000))).collect()] == [0, 240_000, 0, 3_540_000]
    with pytest.raises(Exception, match="OVERFLOW"):
        spark.range(1).select(F.lit(2**63 - 1) + F.col("id") + 1).collect()
    with pytest.raises(Exception, match="OVERFLOW"):
        spark.range(1).select(fn.cap_bytes(F.lit(2**60).cast("bigint"))).collect()


def config(**other):
    given = {"partitions_": 3, "probes": 2, "scorer": {n: 0.5 for n in C.SCORER.values()} | {"neighbours": 9}, "codebook": [[[1.0, 2.0]] * 4] * 2, "centroids": [[float(i)] * 4 for i in range(3)]}
    return C.write_matcher(**{**given, **other})


def test_matcher_configurations(spark):
    m = C.matcher(config(threshold=0.25), 2, 4, 2)
    assert (m["partitions"], m["probes"], m["threshold"], m["scorer"]["neighbours"], m["scorer"]["shape"]) == (3, 2, 0.25, 9, 0.5)
    assert m["centroids"][2] == [2.0] * 4 and len(m["codebook"]) == 2 and C.matcher(config(), 2, 4, 2)["threshold"] == 0.0
    broken = [config(probes=4), config(centroids=[[0.0] * 4] * 2), config(centroids=[[0.0] * 3] * 3), config(codebook=[[[1.0, 2.0]] * 3] * 2), config(scorer={n: 0.5 for n in C.SCORER.values()} | {"neighbours": 0}), config(threshold=float("inf")), config()[:-1], b""]
    for raw in broken:
        with pytest.raises(C.FormatError):
            C.matcher(raw, 2, 4, 2)
    odd = config().replace(b"\x10\x04", b"\x10\x03", 1)
    with pytest.raises(C.FormatError, match="odd"):
        C.matcher(odd, 2, 4, 2)
    content = spark.createDataFrame([("a", bytearray(config())), ("b", bytearray(b"x"))], "path string, content binary")
    got = {(r["path"] or r["error"][0]): r for r in T.matcher_configs(content, 2, 4, 2, strict=False).collect()}
    assert got["a"]["scorer"]["exponent"] == 0.5 and got["b"]["error"]


def test_tables_are_read_by_their_index(spark, tmp_path, monkeypatch):
    rows = sorted((C.record_key("MRT"[i % 3], i // 3), bytes([i % 256]) * 40) for i in range(900))
    data = C.write_table(rows, 500)
    content = spark.createDataFrame([("a", bytearray(data))], "path string, content binary")
    keys = [rows[5][0], rows[700][0], b"nope"]
    assert {(bytes(r["key"]), bytes(r["value"])) for r in T.lookup(content, keys).collect()} == {rows[5], rows[700]}
    t = C.Table(data)
    read = []
    plain = C._block
    monkeypatch.setattr(C, "_block", lambda d, o, n: read.append(o) or plain(d, o, n))
    t.get_many(keys)
    assert len(read) <= 3 < len(t.blocks)
    offsets = {bytes(r["key"]): r["offset"] for r in T.table_offsets(content, [b"R", b"S"]).collect()}
    assert offsets == {k: C.Table(data).approximate_offset(k) for k in (b"R", b"S")}
    assert T.background_mass(content).first()["mass"] == pytest.approx((offsets[b"S"] - offsets[b"R"]) * 0.77596563)


def test_sinks(spark, tmp_path):
    pairs = spark.createDataFrame([("a", bytearray(C.record_key("M", i)), bytearray(b"v%d" % i)) for i in range(20)] + [("b", bytearray(b"k"), bytearray(b"w"))], "file string, key binary, value binary")
    made = T.write_tables(pairs, "key", "value", "file", str(tmp_path / "tables"))
    got = T.scan_tables(made.withColumnRenamed("file", "path"))
    assert sorted((r["path"], bytes(r["key"]), bytes(r["value"])) for r in got.collect()) == sorted((r["file"], bytes(r["key"]), bytes(r["value"])) for r in pairs.collect())
    rows = spark.createDataFrame([(1, "x", None), (2, "", 2.5)], "a int, b string, c double")
    T.write_tsv(rows, str(tmp_path / "tsv"))
    assert sorted(tuple(r) for r in T.tsv(spark, str(tmp_path / "tsv"), "a int, b string, c double").select("a", "c").collect()) == [(1, None), (2, 2.5)]
    metas = spark.createDataFrame([({"rate": "16000", "type": None},), ({"rate": "8000", "type": "x"},)], "m map<string,string>")
    T.write_metadata(metas, "m", str(tmp_path / "meta"))
    back = [r["entries"] for r in T.metadata_files(spark, str(tmp_path / "meta"), "*.txt").collect()]
    assert sorted(back, key=lambda m: m["rate"]) == [{"rate": "16000", "type": "null"}, {"rate": "8000", "type": "x"}]


def test_retention_keeps_two_versions(spark, tmp_path):
    path = str(tmp_path / "history")
    write = S.retain(path, keep_rows=3, keep_ms=100)
    batches = [[(1, "a", 10), (2, "b", 50)], [(3, "c", 120)], [(4, "d", 121), (5, "e", 122)]]
    kind = "id bigint, track_id string, recognized_at_ms bigint"
    for epoch, rows in enumerate(batches):
        for _ in range(2):  # a batch may run twice
            write(spark.createDataFrame(rows, kind), epoch)
    assert sorted(f.name for f in (tmp_path / "history").iterdir()) == ["v1", "v2"]
    assert sorted(r["id"] for r in S.latest(spark, path, spark.createDataFrame([], kind).schema).collect()) == [3, 4, 5]
    assert S.latest(spark, str(tmp_path / "none"), spark.createDataFrame([], kind).schema).count() == 0


def test_detector_weights():
    d = A.Detector.generated()
    raw = b"".join(np.asarray(a, "<f4").tobytes() for k, b in zip(d.kernels, d.biases) for a in (k, b)) + b"".join(np.asarray(a, "<f4").tobytes() for pair in d.dense for a in pair)
    x = np.abs(np.random.default_rng(2).normal(size=(214, 257)))
    assert A.Detector.from_floats(raw).infer(x) == pytest.approx(d.infer(x))
    for bad in (raw[:-4], raw[:-1]):
        with pytest.raises(InvalidInput):
            A.Detector.from_floats(bad)
    assert struct.calcsize("f") == 4


InvalidInput = C.InvalidInput
