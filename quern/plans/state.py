"""Catalog state, results, histories and their files over the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import catalog, policy, state
from quern.plans import policies, vectors
from quern.plans.vectors import table
from quern.sources import codecs, tables
from quern.sources.saved import shared

STORE = 50  #: documents whose packs a store holds


def _stores(spark, sf_dir):
    """Packs by store, the objects that each holds, and the document that each wrote, some of them broken."""
    packs = policies._packs(spark, sf_dir).select(F.floor(F.col("pos") / STORE).alias("store"), "pos", "name", "size")
    objects = packs.where("pos % 13 <> 5 or store % 3 = 0").withColumn("size", F.when((F.col("pos") % 97 == 0) & (F.col("store") % 4 == 1), F.col("size") + 1).otherwise(F.col("size"))).withColumn("valid", F.col("pos") % 11 != 0)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "name", "size"))), lambda x: F.struct(x["name"].alias("name"), x["size"].alias("size")))
    country = F.when(F.col("store") % 7 == 3, "GBX").otherwise(F.lit("gb"))
    wanted = packs.groupBy("store").agg(listed.alias("packs")).select("store", F.lit("20240101-000000").alias("build"), country.alias("country"), "packs", (F.col("store") % 2 == 0).alias("complete"))
    documents = wanted.select("store", F.when(F.col("store") % 11 == 6, "{").when(F.col("store") % 11 == 7, F.lit(None)).otherwise(state.active_document()).alias("document"))
    return wanted, objects, documents


def catalog_state(spark, sf_dir):
    """What each store shows, of documents written to files and read again."""
    _, objects, documents = _stores(spark, sf_dir)
    path = shared(spark, "active")
    state.write_active(documents.select(F.to_json(F.struct("store", "document")).alias("document")), path)
    read = spark.read.text(path).select(F.from_json("value", "store bigint, document string").alias("d")).select("d.*")
    return state.catalog_state(state.read_active(read, objects))


def catalog_activate(spark, sf_dir):
    wanted, objects, _ = _stores(spark, sf_dir)
    return state.activate(wanted, objects, strict=False)


def catalog_delete(spark, sf_dir):
    _, objects, _ = _stores(spark, sf_dir)
    rest, gone = state.delete_downloaded(objects)
    return gone.join(rest.groupBy("store").agg(F.count("*").alias("left")), "store", "left").select("store", "files", "bytes", F.coalesce("left", F.lit(0)).alias("left"))


def catalog_ensure(spark, sf_dir):
    wanted, objects, _ = _stores(spark, sf_dir)
    packs = wanted.select("store", F.explode("packs").alias("p")).select("store", "p.*")
    return state.ensure_objects(packs, objects).groupBy("store", "action").agg(F.count("*").alias("packs"), F.sum("size").alias("bytes"))


def config_decode(spark, sf_dir):
    """A configuration of the index's own centroids and codebook, encoded and decoded."""
    index = vectors.index_of(spark, sf_dir)
    s = vectors.SETTINGS
    names = codecs.SCORER.values()
    data = codecs.write_matcher(s.partitions, s.probes, {n: getattr(s.scoring, n) for n in (*names, "neighbours")}, index.codebook.tolist(), index.centroids.tolist(), s.threshold)
    content = spark.createDataFrame([("config", bytearray(data))], "path string, content binary")
    got = tables.matcher_configs(content, s.subspaces, s.words, index.codebook.shape[2])
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))
    centroids = got.select(F.posexplode("centroids").alias("i", "v")).select(F.lit("centroid").alias("kind"), F.lit(0).alias("m"), "i", F.round(total("v"), 5).alias("total"))
    words = got.select(F.posexplode("codebook").alias("m", "s")).select("m", F.posexplode("s").alias("i", "v")).select(F.lit("codeword").alias("kind"), "m", "i", F.round(total("v"), 5).alias("total"))
    plain = got.select(F.lit("setting").alias("kind"), F.lit(0).alias("m"), F.posexplode(F.array("partitions", "probes", "neighbours", F.col("threshold").cast("bigint"))).alias("i", "v")).select("kind", "m", "i", F.col("v").cast("double").alias("total"))
    return centroids.unionByName(words).unionByName(plain)


def table_lookup(spark, sf_dir):
    """The same keys as table_multi_get, by the blocks that the index names."""
    from quern.plans.signals import _content

    keys = [codecs.record_key("M", i) for i in (0, 3, 4, 77)]
    return tables.lookup(_content(spark, sf_dir), keys).select("path", F.hex("key").alias("key"), F.octet_length("value").alias("size"))


def _results(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    title = F.concat(F.lit('a "b" \\ c\t'), "event_type")
    match = F.when(F.col("event_type") == "purchase", F.struct(title.alias("title"), F.lit("é\n\u0001").alias("artist"), F.concat(F.lit("t"), "user_id").alias("trackId"), "user_id", F.lit("S").alias("shard"), F.floor("value").cast("double").alias("score"), (F.col("event_id") % 300).alias("offset"), F.when(F.col("event_id") % 3 != 0, F.lit(180.5)).alias("duration")))
    continuity = F.when(F.col("event_id") % 4 == 0, F.struct(F.lit("S"), F.col("user_id"), F.lit(1.5), F.col("event_id") % 9))
    music = F.when(F.col("event_id") % 5 != 0, F.lit(0.25))
    return e.select("event_id", state.result_document(music, continuity, match).alias("document"))


def result_json(spark, sf_dir):
    """Results as JSON text, which ends in the middle for some, read again."""
    rows = _results(spark, sf_dir).withColumn("document", F.when(F.col("event_id") % 17 == 0, F.substring("document", 1, 20)).otherwise(F.col("document")))
    rows = rows.withColumn("r", state.parse_result(F.col("document")))
    return rows.select("event_id", F.col("r.musicScore").alias("music"), F.col("r.continuity.offset").alias("continued"), F.col("r.match.title").alias("title"), F.col("r.match.artist").alias("artist"), F.col("r.match.offset").alias("offset"), F.col("r.match.duration").alias("duration"))


def state_json(spark, sf_dir):
    """Each user's history as JSON text, some of it broken, read again: entries, matches and the greatest offset."""
    e = policies.history_of(spark, sf_dir)
    entry = F.struct("at_ms", "matched", F.when(F.col("matched"), F.array("offset_ms", F.col("offset_ms") - 2000)).alias("offsets_ms"), "duration_ms")
    text = e.groupBy("user_id").agg(state.encode_entries(F.array_sort(F.collect_list(entry))).alias("document"))
    broken = F.when(F.col("user_id") % 10 == 3, F.concat(F.lit("["), "document")).when(F.col("user_id") % 10 != 4, F.col("document"))
    got = text.select("user_id", state.parse_entries(broken).alias("h"))
    most = F.array_max(F.transform("h", lambda x: state.newest_offset(x["offsets_ms"])))
    return got.select("user_id", F.size("h").alias("entries"), F.size(F.filter("h", lambda x: x["matched"])).alias("matches"), most.alias("most_ms"))


def squelch_offsets(spark, sf_dir):
    """The back-off of matches with several offsets, the greatest of which counts; none for some."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    h = policies.history_of(spark, sf_dir).join(e.select("event_id", k.alias("k")), "event_id")
    lists = F.when(F.col("matched"), F.when(F.col("k") % 5 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.col("offset_ms") - 2000, "offset_ms", F.lit(-9).cast("bigint"))))
    rows = h.withColumn("offset_ms", state.newest_offset(lists)).drop("k")
    return policy.squelch(rows).select("user_id", "event_id", "squelch_ms", "next_delay_ms")


def parity_files(spark, sf_dir):
    """parity_compare over a table of tab-separated text and files of JSON."""
    actual, expected = policies.parity_sides(spark, sf_dir)
    a, b = shared(spark, "parity"), shared(spark, "parity")
    tables.write_tsv(actual, a)
    expected.write.json(b)
    kinds = "capture bigint, accepted boolean, track string, shard string, offset bigint, score double"
    return catalog.parity_summary(catalog.parity(tables.tsv(spark, a, kinds), tables.read_json(spark, b, kinds)))


def _history(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return state.history_table(e.select(F.col("event_id").alias("id"), F.concat(F.lit("track "), "user_id").alias("track"), F.lit("artist").alias("artist"), F.concat(F.lit("t"), "user_id").alias("track_id"), F.lit("S").alias("shard"), F.col("user_id").alias("numeric_id"), (F.col("event_id") % 300).alias("offset_seconds"), "value", F.unix_millis(F.col("ts").cast("timestamp")).alias("recognized_at_ms")).withColumnRenamed("value", "score"))


def history_clear_delete(spark, sf_dir):
    """Rows of the history after a row, one that isn't there, and all rows are deleted, and how many went."""
    h = _history(spark, sf_dir)
    first = h.agg(F.min("id")).first()[0]
    out = None
    for name, (rest, gone) in {"one": policy.remove(h, first), "missing": policy.remove(h, -1), "all": policy.clear(h)}.items():
        one = rest.agg(F.lit(name).alias("what"), F.count("*").alias("left"), F.coalesce(F.max("id"), F.lit(-1)).alias("last")).crossJoin(F.broadcast(gone))
        out = one if out is None else out.unionByName(one)
    return out


def device_gates(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    bit = lambda m: F.when(F.col("event_id") % (m + 2) != 0, F.col("event_id") % m != 0)
    action = F.when(F.col("event_id") % 4 == 0, F.lit(state.BOOTED[0])).when(F.col("event_id") % 4 == 1, F.lit(state.BOOTED[1])).when(F.col("event_id") % 4 == 2, "other")
    delay = policy.rearm_delay(F.lit(55_000).cast("bigint"), F.col("event_id") * 10 % 90_000)
    return e.select("event_id", state.can_arm(bit(2), bit(3), bit(5)).alias("arm"), state.wants_immediate_sync(action, F.col("event_id") % 3 == 0).alias("sync"), delay.alias("delay_ms"))


QUERIES = {f.__name__: f for f in (catalog_state, catalog_activate, catalog_delete, catalog_ensure, config_decode, table_lookup, result_json, state_json, squelch_offsets, parity_files, history_clear_delete, device_gates)}

_STORES = policies._P + f""", packs AS (SELECT pos // {STORE} AS store, pos, name, size FROM p),
objects AS (SELECT store, name, CASE WHEN pos % 97 = 0 AND store % 4 = 1 THEN size + 1 ELSE size END AS size, pos % 11 <> 0 AS valid FROM packs WHERE pos % 13 <> 5 OR store % 3 = 0),
missing AS (SELECT store, count(*) AS n FROM packs ANTI JOIN objects USING (store, name, size) GROUP BY store),
stores AS (SELECT store, CASE WHEN store % 7 = 3 THEN 'GBX' ELSE 'gb' END AS country, count(*) AS n, sum(size)::BIGINT AS bytes, store % 2 = 0 AS complete,
  '[' || string_agg('{{"name":"' || name || '","size":' || size || '}}', ',' ORDER BY pos) || ']' AS listed FROM packs GROUP BY store)
"""
_J = "(props->>'$.k')::BIGINT"
ORACLES = {
    "catalog_state": _STORES + """, ok AS (SELECT s.*, m.n IS NULL AND country = 'gb' AND store % 11 NOT IN (6, 7) AS ok FROM stores s LEFT JOIN missing m USING (store))
SELECT store, CASE WHEN ok THEN '20240101-000000' END AS build, CASE WHEN ok THEN country END AS country, CASE WHEN ok THEN n ELSE 0 END::INT AS shards, CASE WHEN ok THEN bytes ELSE 0 END::BIGINT AS bytes, ok AND complete AS complete FROM ok""",
    "catalog_activate": _STORES + """SELECT s.store, CASE WHEN m.n IS NULL THEN '{"build":"20240101-000000","country":"' || country || '","packs":' || listed || ',"complete":' || complete::VARCHAR || '}' END AS document,
CASE WHEN m.n IS NOT NULL THEN 'the catalog has a missing or truncated shard' END AS error FROM stores s LEFT JOIN missing m USING (store)""",
    "catalog_delete": _STORES + "SELECT store, count(*) AS files, sum(size)::BIGINT AS bytes, 0::BIGINT AS \"left\" FROM objects GROUP BY store",
    "catalog_ensure": _STORES + "SELECT store, CASE WHEN o.size = p.size AND valid THEN 'reuse' ELSE 'fetch' END AS action, count(*) AS packs, sum(p.size)::BIGINT AS bytes FROM packs p LEFT JOIN objects o USING (store, name) GROUP BY ALL",
    "config_decode": """SELECT 'centroid' AS kind, 0 AS m, vec_id::INT AS i, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings WHERE vec_id < 32 UNION ALL
SELECT 'codeword', m::INT, vec_id::INT, round(list_sum(list_transform(embedding[m * 8 + 1 : m * 8 + 8], lambda x: x::DOUBLE)), 5) FROM embeddings, range(8) AS r(m) WHERE vec_id < 256 UNION ALL
SELECT 'setting', 0, i::INT, v FROM (VALUES (0, 32.0::DOUBLE), (1, 4.0), (2, 200.0), (3, 100.0)) AS s(i, v)""",
    "table_lookup": vectors._BASE + "SELECT 'shard-' || shard AS path, '4D' || printf('%02X', track_id::INT) || '0000' AS key, 2 + length(title)::INT AS size FROM meta WHERE track_id IN (0, 3, 4)",
    "result_json": """SELECT event_id, CASE WHEN ok AND event_id % 5 <> 0 THEN 0.25::DOUBLE END AS music, CASE WHEN ok AND event_id % 4 = 0 THEN event_id % 9 END AS continued,
CASE WHEN ok AND p THEN 'a "b" \\ c' || chr(9) || event_type END AS title, CASE WHEN ok AND p THEN 'é' || chr(10) || chr(1) END AS artist, CASE WHEN ok AND p THEN event_id % 300 END AS "offset", CASE WHEN ok AND p AND event_id % 3 <> 0 THEN 180.5::DOUBLE END AS duration
FROM (SELECT *, event_id % 17 <> 0 AS ok, event_type = 'purchase' AS p FROM events)""",
    "state_json": policies._H + """SELECT user_id, CASE WHEN user_id % 10 IN (3, 4) THEN 0 ELSE count(*) END::INT AS entries, CASE WHEN user_id % 10 IN (3, 4) THEN 0 ELSE count(*) FILTER (matched) END::INT AS matches,
CASE WHEN user_id % 10 NOT IN (3, 4) THEN max(offset_ms) END AS most_ms FROM h GROUP BY user_id""",
    "squelch_offsets": policies._SQUELCH.format(adapt=720_000).replace("floor(value)::BIGINT * 1000 END AS offset_ms", f"CASE WHEN {_J} % 5 <> 0 THEN greatest(floor(value)::BIGINT * 1000, -9) END END AS offset_ms"),
    "parity_files": policies.ORACLES["parity_compare"],
    "history_clear_delete": """WITH s AS (SELECT count(*) AS n, max(event_id) AS last FROM events WHERE event_type = 'purchase')
SELECT 'one' AS what, n - 1 AS "left", last, 1::BIGINT AS gone FROM s UNION ALL SELECT 'missing', n, last, 0 FROM s UNION ALL SELECT 'all', 0, -1, n FROM s""",
    "device_gates": """SELECT event_id, event_id % 4 <> 0 AND event_id % 2 <> 0 AND event_id % 5 <> 0 AND event_id % 3 <> 0 AND event_id % 7 <> 0 AS arm, event_id % 3 <> 0 AND event_id % 4 IN (0, 1) AS sync,
greatest(55000 - event_id * 10 % 90000, 0)::BIGINT AS delay_ms FROM events""",
}
