"""Policy, history, catalog, gates and scalar functions over the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import scalars as fn
from quern.operators import audio, catalog, policy
from quern.plans.vectors import table


def history_of(spark, sf_dir):
    """Events as recognitions: purchases are matches."""
    e = table(spark, sf_dir, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    k = F.get_json_object("props", "$.k").cast("bigint")
    value = F.floor(F.col("value")).cast("bigint")
    matched = F.col("event_type") == "purchase"
    return e.select("user_id", "event_id", ms.alias("at_ms"), matched.alias("matched"), F.when(matched, value * 1000).alias("offset_ms"), F.when(matched & (k % 7 != 0), value * 1000 + k * 1000).alias("duration_ms"))


def squelch(spark, sf_dir):
    return policy.squelch(history_of(spark, sf_dir)).select("user_id", "event_id", "squelch_ms", "next_delay_ms")


def squelch_wide(spark, sf_dir):
    return policy.squelch(history_of(spark, sf_dir), 5 * 86_400_000).select("user_id", "event_id", "squelch_ms", "next_delay_ms")


def projected_previous(spark, sf_dir):
    return policy.projected_previous(history_of(spark, sf_dir), 72_000_000).select("user_id", "event_id", "match_id", "offset_seconds")


def on_demand_depth(spark, sf_dir):
    step = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), step.alias("step"))
    return policy.on_demand_depth(e).select("user_id", "event_id", "depth")


def _stored(spark, sf_dir):
    h = history_of(spark, sf_dir).where("matched")
    return h.select(F.col("event_id").alias("id"), F.concat(F.lit("t"), "user_id").alias("track_id"), F.col("at_ms").alias("recognized_at_ms"))


def history_newest(spark, sf_dir):
    return policy.newest_first(_stored(spark, sf_dir), 50)


def history_prune(spark, sf_dir):
    return policy.pruned(_stored(spark, sf_dir), 500, 15 * 86_400_000)


def history_insert_delete(spark, sf_dir):
    h = _stored(spark, sf_dir)
    new = h.where("id % 100 = 7").select(F.concat(F.lit("new-"), "track_id").alias("track_id"), (F.col("recognized_at_ms") + 1).alias("recognized_at_ms"))
    return policy.delete(policy.insert(h, new), 11)


def _packs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.lit("20240101-000000").alias("build"), F.col("doc_id").alias("pos"), F.concat(F.upper(F.substring("lang", 1, 2)), F.md5(F.col("doc_id").cast("string"))).alias("name"), F.greatest("n_chars", F.lit(1).cast("bigint")).alias("size"), F.concat_ws(" , ", F.upper("lang"), F.when(F.col("doc_id") % 3 == 0, F.lit("gb"))).alias("extra_country_codes"))


def catalog_parse(spark, sf_dir):
    """Every document as a pack, in as many builds as hold ``MAX_PACKS`` ids each, a second apart."""
    at = F.make_dt_interval(secs=F.floor(F.col("pos") / catalog.MAX_PACKS).cast("decimal(18,6)"))
    p = _packs(spark, sf_dir).withColumn("build", F.date_format(F.expr("timestamp_ntz'2024-01-01 00:00:00'") + at, "yyyyMMdd-HHmmss"))
    document = p.groupBy("build").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name", "size", "extra_country_codes"))), lambda x: F.struct(x["name"].alias("name"), x["size"].alias("size"), x["size"].alias("compressed_size"), F.array(F.concat(F.lit("https://h/"), x["name"])).alias("download_urls"), F.when(x["pos"] % 5 == 4, F.lit("other")).otherwise(F.lit("shard")).alias("extra_type"), x["extra_country_codes"].alias("extra_country_codes"))).alias("packs"))).alias("document"))
    return catalog.parse_manifests(document).select("build", "name", "size", F.array_join("country_codes", ",").alias("codes"))


def catalog_select(spark, sf_dir):
    p = _packs(spark, sf_dir).withColumn("country_codes", fn.countries(F.col("extra_country_codes")))
    return catalog.select_packs(p, "gb", 200_000).select("pos", "name", "size", "total")


def catalog_prefix(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars")
    return catalog.pack_prefix(d, ["lang"], "doc_id", "n_chars", 150_000).select("lang", "doc_id", "n_chars", "total")


def catalog_diff(spark, sf_dir):
    p = _packs(spark, sf_dir)
    return catalog.catalog_diff(p.where("pos % 3 <> 0"), p.where("pos % 2 = 0").withColumn("size", F.when(F.col("pos") % 10 == 0, F.col("size") + 1).otherwise(F.col("size"))))


def latest_build(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    name = F.concat(F.lit("builds/"), F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd-HHmmss"), F.when(F.col("event_id") % 2 == 0, "/").otherwise("x/"))
    return catalog.latest_build(e.select(F.array(name).alias("prefixes")))


def capture_block(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    state = e.select("event_id", (F.col("event_id") % 17 == 0).cast("int").alias("on_demand"), F.when(F.col("event_id") % 13 != 0, F.col("event_id") % 5 != 0).alias("user_foreground"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 4 != 0).alias("main_user_foreground"), F.when(F.col("event_id") % 11 != 0, F.when(F.col("event_id") % 7 == 0, 2).otherwise(0)).alias("call_state"), F.when(F.col("event_id") % 19 != 0, F.col("event_id") % 2).alias("recordings"))
    return state.select("event_id", policy.block_reason().alias("reason"))


def playback_gate(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select("user_id", "event_id", F.when(F.col("event_id") % 9 != 0, F.concat(F.when(F.col("event_id") % 4 == 0, F.lit("com.breel.wallpapers.")).otherwise(F.lit("app.")), "event_type")).alias("package"), (F.col("event_id") % 2 + 1).alias("usage"), (F.col("event_id") % 3 + 1).alias("content"), (F.col("event_id") % 5 + 1).alias("state"))
    ok = rows.where(policy.music_playback(F.col("package"), F.col("usage"), F.col("content"), F.col("state")))
    return ok.groupBy("user_id").agg(F.min_by("package", "event_id").alias("package"), F.min("event_id").alias("event_id"))


def music_gate(spark, sf_dir):
    """Score of each window; a capture passes if any is above 0.2, and reports its first."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("capture_id"), F.col("event_id").alias("wi"), (F.pmod(F.col("event_id") * 37, F.lit(100)) / 400.0).alias("score"))
    return audio.gate(e).withColumnRenamed("capture_id", "user_id")


def parity_sides(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    row = lambda noise: e.select(F.col("event_id").alias("capture"), (F.col("event_type") != "error").alias("accepted"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("track"), F.lit("S").alias("shard"), F.when(F.col("event_id") % 101 != 0, F.col("event_id") % 60).alias("offset"), (F.col("value") + noise).alias("score"))
    actual, expected = row(F.lit(0.0)), row(F.when(F.col("event_id") % 10 == 0, F.lit(0.5)).otherwise(F.lit(0.0))).withColumn("offset", F.when(F.col("capture") % 50 == 1, F.col("offset") + 1).otherwise(F.col("offset")))
    return actual, expected


def parity_compare(spark, sf_dir):
    return catalog.parity_summary(catalog.parity(*parity_sides(spark, sf_dir)))


def scalar_functions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    x = F.col("value") - 50
    return e.select("event_id", F.round(fn.softplus(x / 10), 6).alias("softplus"), fn.round_half_up(x * 100, 2000).alias("grid"), F.round(fn.sigmoid(x / 10), 6).alias("sigmoid"), F.round(fn.elu(x / 10), 6).alias("elu"), fn.relu(x).alias("relu"), fn.clamp(x, -20.0, 20.0).alias("clamped"), fn.cap_bytes((F.col("event_id") % 5 - 2).cast("bigint")).alias("cap"), F.hex(fn.record_key("M", F.col("event_id"))).alias("key"), fn.within(x, x + 0.5, 0.25).alias("near"), fn.display_text(F.col("event_type"), F.when(F.col("event_id") % 2 == 0, F.lit(" ")).otherwise(F.lit("A"))).alias("display"))


def embedding_norms(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double") * (F.col("vec_id") + 1)).alias("v"))
    return e.select("vec_id", F.posexplode(fn.l2_normalize(F.col("v"))).alias("i", "x")).select("vec_id", "i", F.round("x", 6).alias("x"))


def base_urls(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    shaped = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("  "), F.regexp_replace("url", "^http:", "https:"), F.lit("//"))).when(F.col("page_id") % 4 == 1, F.concat(F.col("url"), F.lit("?q=1"))).otherwise(F.col("url"))
    return p.select("page_id", fn.base_url(shaped).alias("base"))


def reverse_index_unpack(spark, sf_dir):
    """Partition lists packed to bytes as the tables hold them, and unpacked with bit operations."""
    e = table(spark, sf_dir, "events")
    number = lambda s: F.col("event_id") * (s * 7 + 13) % 1000
    a, b, c, d = (number(s) for s in range(4))
    last = F.when(F.col("event_id") % 3 == 0, F.lit(1023)).otherwise(d)
    upper = sum(F.shiftright(x.cast("int"), 8) * 4**i for i, x in enumerate((a, b, c, last)))
    five = F.concat(*(F.lpad(F.hex(x.cast("bigint").bitwiseAND(255)), 2, "0") for x in (a, b, c, last, upper)))
    return e.select("event_id", F.posexplode(fn.unpack_partitions(F.unhex(five))).alias("occurrence", "partition"))


def labelled_semi_anti(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return d.join(lab, "doc_id", "left_semi").groupBy("lang").agg(F.count("*").alias("n")).withColumn("kind", F.lit("toxic")).unionByName(d.join(lab, "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("n")).withColumn("kind", F.lit("other")))


def turn_windows(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return c.select("conv_id", "turn", F.lag("role").over(w).alias("before"), F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"), F.dense_rank().over(w).alias("rank"))


def revenue_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate < timestamp_ntz'1997-01-01'")
    return rows.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")), 2).cast("double").alias("revenue"))


_H = """WITH h AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS at_ms, event_type = 'purchase' AS matched, CASE WHEN event_type = 'purchase' THEN floor(value)::BIGINT * 1000 END AS offset_ms,
CASE WHEN event_type = 'purchase' AND (props->>'$.k')::BIGINT % 7 <> 0 THEN floor(value)::BIGINT * 1000 + (props->>'$.k')::BIGINT * 1000 END AS duration_ms FROM events),
stored AS (SELECT event_id AS id, 't' || user_id AS track_id, at_ms AS recognized_at_ms FROM h WHERE matched)
"""
_SQUELCH = _H + """, w AS (SELECT *, count(*) OVER r AS n, bool_or(matched) OVER r AS any_match, max(struct_pack(e := event_id, m := matched, d := duration_ms, o := offset_ms)) OVER s AS last FROM h
WINDOW r AS (PARTITION BY user_id ORDER BY at_ms RANGE BETWEEN {adapt} PRECEDING AND CURRENT ROW), s AS (PARTITION BY user_id ORDER BY at_ms RANGE BETWEEN CURRENT ROW AND CURRENT ROW)),
d AS (SELECT user_id, event_id, n, any_match, last, last.d - 8000 - floor(last.o / 2000.0 + 0.5)::BIGINT * 2000 AS remaining FROM w),
c AS (SELECT user_id, event_id, greatest(15000, least(180000, CASE WHEN NOT any_match THEN CASE WHEN n >= 10 THEN 90000 ELSE 55000 END WHEN NOT last.m THEN 55000 WHEN last.d IS NULL OR last.o IS NULL THEN 55000
 WHEN remaining < 50000 THEN least(greatest(remaining + 5000, 20000), 90000) ELSE 55000 END))::BIGINT AS squelch_ms FROM d)
SELECT user_id, event_id, squelch_ms, squelch_ms + 4000 AS next_delay_ms FROM c"""
_P = """WITH p AS (SELECT '20240101-000000' AS build, doc_id AS pos, upper(lang[1:2]) || md5(doc_id::VARCHAR) AS name, greatest(n_chars, 1) AS size, lang, CASE WHEN doc_id % 3 = 0 THEN lang || ',gb' ELSE lang END AS codes FROM documents)
"""
QUERIES = {f.__name__: f for f in (squelch, squelch_wide, projected_previous, on_demand_depth, history_newest, history_prune, history_insert_delete, catalog_parse, catalog_select, catalog_prefix, catalog_diff, latest_build, capture_block, playback_gate, music_gate, parity_compare, scalar_functions, embedding_norms, base_urls, reverse_index_unpack, labelled_semi_anti, turn_windows, revenue_rollup)}
ORACLES = {
    "squelch": _SQUELCH.format(adapt=720_000),
    "squelch_wide": _SQUELCH.format(adapt=5 * 86_400_000),
    "projected_previous": _H + """SELECT user_id, event_id, m.event_id AS match_id, (m.offset_ms + at_ms - m.at_ms) / 1000.0 AS offset_seconds FROM
(SELECT *, last_value(CASE WHEN matched THEN struct_pack(at_ms := at_ms, event_id := event_id, offset_ms := offset_ms) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY at_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM h)
WHERE m IS NOT NULL AND at_ms - m.at_ms BETWEEN 0 AND 72000000""",
    "on_demand_depth": """WITH s AS (SELECT user_id, event_id, ts, sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM events)
SELECT user_id, event_id, (s - least(min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0))::BIGINT AS depth FROM s""",
    "history_newest": _H + "SELECT * FROM stored ORDER BY recognized_at_ms DESC, id DESC LIMIT 50",
    "history_prune": _H + "SELECT * FROM stored WHERE recognized_at_ms >= (SELECT arg_max(recognized_at_ms, id) FROM stored) - 1296000000 ORDER BY recognized_at_ms DESC, id DESC LIMIT 500",
    "history_insert_delete": _H + """SELECT id, track_id, recognized_at_ms FROM stored WHERE id <> 11 UNION ALL
SELECT (SELECT max(id) FROM stored) + row_number() OVER (ORDER BY recognized_at_ms + 1, 'new-' || track_id), 'new-' || track_id, recognized_at_ms + 1 FROM stored WHERE id % 100 = 7""",
    "catalog_parse": _P + "SELECT strftime(TIMESTAMP '2024-01-01' + to_seconds(pos // 10000), '%Y%m%d-%H%M%S') AS build, name, size, codes FROM p WHERE pos % 5 <> 4",
    "catalog_select": _P + "SELECT pos, name, size, total::BIGINT AS total FROM (SELECT *, sum(size) OVER (ORDER BY pos) AS total FROM p WHERE pos % 3 = 0) WHERE total <= 200000",
    "catalog_prefix": "SELECT lang, doc_id, n_chars, total::BIGINT AS total FROM (SELECT lang, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id) AS total FROM documents) WHERE total <= 150000",
    "catalog_diff": _P + """, d AS (SELECT name, size FROM p WHERE pos % 3 <> 0), a AS (SELECT name, CASE WHEN pos % 10 = 0 THEN size + 1 ELSE size END AS size FROM p WHERE pos % 2 = 0)
SELECT *, 'keep' AS action FROM (SELECT * FROM d INTERSECT SELECT * FROM a) UNION ALL SELECT *, 'fetch' FROM (SELECT * FROM d EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'drop' FROM (SELECT * FROM a EXCEPT SELECT * FROM d)""",
    "latest_build": "SELECT max(strftime(ts, '%Y%m%d-%H%M%S')) AS build FROM events WHERE event_id % 2 = 0",
    "capture_block": """SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'an on-demand session is active' WHEN NOT coalesce(CASE WHEN event_id % 13 <> 0 THEN event_id % 5 <> 0 END, false) THEN 'the app user is not foreground'
WHEN event_id % 3 = 0 AND event_id % 4 = 0 THEN 'the main user is not foreground' WHEN event_id % 11 = 0 THEN 'phone state is unavailable' WHEN event_id % 7 = 0 THEN 'a phone call is active' WHEN event_id % 19 = 0 THEN 'AudioManager is unavailable' WHEN event_id % 2 = 1 THEN 'another audio recording is active' END AS reason FROM events""",
    "playback_gate": """SELECT user_id, arg_min(package, event_id) AS package, min(event_id) AS event_id FROM (SELECT user_id, event_id, CASE WHEN event_id % 9 <> 0 THEN (CASE WHEN event_id % 4 = 0 THEN 'com.breel.wallpapers.' ELSE 'app.' END) || event_type END AS package FROM events
WHERE event_id % 2 = 0 AND event_id % 3 = 1 AND event_id % 5 = 1) WHERE package IS NULL OR NOT starts_with(package, 'com.breel.wallpapers') GROUP BY user_id""",
    "music_gate": "SELECT user_id, bool_or((event_id * 37 % 100) / 400.0 > 0.2) AS passes, arg_min((event_id * 37 % 100) / 400.0, event_id) AS music_score FROM events GROUP BY user_id",
    "parity_compare": """SELECT count(*) AS total, count(*) FILTER (event_id % 101 <> 0 AND event_id % 50 = 1) AS disagreements, count(*) FILTER (event_id % 10 = 0) AS score_disagreements FROM events""",
    "scalar_functions": """SELECT event_id, round(greatest(x / 10, 0) + ln(1 + exp(-abs(x / 10))), 6) AS softplus, (floor(x * 100 / 2000.0 + 0.5) * 2000)::BIGINT AS grid, round(1 / (1 + exp(-x / 10)), 6) AS sigmoid, round(CASE WHEN x / 10 > 0 THEN x / 10 ELSE exp(x / 10) - 1 END, 6) AS elu, greatest(x, 0.0) AS relu, least(greatest(x, -20.0), 20.0) AS clamped,
CASE WHEN event_id % 5 - 2 > 0 THEN (event_id % 5 - 2) * 1048576 END AS cap, '4D' || printf('%02X%02X%02X', event_id & 255, (event_id >> 8) & 255, (event_id >> 16) & 255) AS key, false AS near, event_type || CASE WHEN event_id % 2 = 0 THEN '' ELSE ' • A' END AS display FROM (SELECT *, value - 50 AS x FROM events)""",
    "embedding_norms": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE * (vec_id + 1)) AS v FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda e: e * e))) AS n FROM v)
SELECT vec_id, i::INT AS i, round(v[i + 1] / n, 6) AS x FROM n, (SELECT unnest(range(64)) AS i)""",
    "base_urls": """SELECT page_id, CASE WHEN regexp_matches(u, '^https://[^/?#]+') AND NOT contains(u, '?') AND NOT contains(u, '#') THEN u END AS base FROM (SELECT page_id, regexp_replace(trim(CASE page_id % 4 WHEN 0 THEN '  ' || regexp_replace(url, '^http:', 'https:') || '//' WHEN 1 THEN url || '?q=1' ELSE url END), '/+$', '') AS u FROM pages)""",
    "reverse_index_unpack": """SELECT event_id, s::INT AS occurrence, (event_id * (s * 7 + 13) % 1000)::INT AS partition FROM events, (SELECT unnest(range(4)) AS s) WHERE NOT (s = 3 AND event_id % 3 = 0)""",
    "labelled_semi_anti": "SELECT lang, count(*) AS n, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'toxic' ELSE 'other' END AS kind FROM documents GROUP BY lang, kind",
    "turn_windows": "SELECT conv_id, turn, lag(role) OVER w AS before, (sum(length(text)) OVER w)::BIGINT AS run, (dense_rank() OVER w)::INT AS rank FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "revenue_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS revenue FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01' GROUP BY ROLLUP (l_returnflag, l_linestatus)",
}
