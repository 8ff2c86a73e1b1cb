"""Streaming queries: each runs its stream to the end of its files and returns what the sink holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import policy
from quern.plans import policies, vectors
from quern.plans.policies import _SQUELCH
from quern.plans.vectors import table
from quern.sources.saved import shared
from quern.streaming import policy as S


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _in_turn(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    """A stream that takes each of the frames as a batch of its own, in order."""
    path = shared(spark, "turns")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)  # files are taken in order of their time
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(rows: DataFrame, mode: str, name: str, write) -> None:
    rows.writeStream.outputMode(mode).option("checkpointLocation", f"{name}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def _drained(rows: DataFrame, mode: str) -> DataFrame:
    """All rows that the stream has emitted once its input is used up, from files that every executor can read: of a complete result the last batch."""
    spark = rows.sparkSession
    name = shared(spark, "stream")
    epochs = [-1]

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{name}/out/epoch={epoch}")
        epochs.append(epoch)

    _run(rows, mode, name, keep)
    out = spark.read.schema(rows.schema).option("basePath", f"{name}/out").parquet(f"{name}/out" + (f"/epoch={epochs[-1]}" if mode == "complete" else ""))
    return out.select(*rows.schema.names)


DAY = 86_400_000


def _squelched(rows: DataFrame) -> DataFrame:
    """The policy over a stream of events: an adaptation window of 5 days, and 40 days until an event expires."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    value = F.floor(F.col("value")).cast("bigint")
    matched = F.col("event_type") == "purchase"
    step = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    rows = rows.withWatermark("ts", "40 days").select("user_id", "event_id", "ts", F.unix_millis("ts").alias("at_ms"), matched.alias("matched"), F.when(matched, value * 1000).alias("offset_ms"), F.when(matched & (k % 7 != 0), value * 1000 + k * 1000).alias("duration_ms"), step.alias("step"))
    return _drained(S.squelch_stream(rows, 5 * DAY, 40 * DAY), "append")


def stream_squelch(spark, sf_dir):
    return _squelched(_stream(spark, sf_dir)).select("user_id", "event_id", "squelch_ms", "next_delay_ms", "depth")


def stream_projection(spark, sf_dir):
    """The former match of each event as it would stand now, from the state of its key."""
    return _squelched(_stream(spark, sf_dir)).where("match_id is not null").select("user_id", "event_id", "match_id", "offset_seconds")


def stream_expiry(spark, sf_dir):
    """One more event of each user, 100 days after all others: nothing before it counts any more but the depth, which is kept."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    last = e.agg(F.max("ts").alias("_last"))
    more = e.select("user_id").distinct().crossJoin(F.broadcast(last)).withColumns({"event_id": (F.lit(10**9) + F.col("user_id")).cast(e.schema["event_id"].dataType), "ts": F.col("_last") + F.expr("INTERVAL 100 DAYS"), "event_type": F.lit("click")})
    more = more.select(*(F.col(f.name) if f.name in more.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in e.schema.fields))
    return _squelched(_in_turn(spark, [e, more])).where("event_id >= 1000000000").select("user_id", "squelch_ms", "match_id", "depth")


def _ended(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The table's events, then an event far ahead, whose time closes all windows before it."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    last = e.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"))
    return e, last.select(*(F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in e.schema.fields))


def stream_window_counts(spark, sf_dir):
    done = _drained(S.counts(_in_turn(spark, list(_ended(spark, sf_dir)))), "append")
    return done.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def stream_late_counts(spark, sf_dir):
    """Events in two batches, then all of them again as if they had come a year late, which count no more: what is late is told by the batch before last."""
    e, last = _ended(spark, sf_dir)
    late = e.withColumn("ts", F.col("ts") - F.expr("INTERVAL 365 DAYS"))
    done = _drained(S.counts(_in_turn(spark, [e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), late, last])), "append")
    return done.groupBy("event_type").agg(F.count("*").alias("windows"), F.sum("n").alias("n"))


def stream_running_counts(spark, sf_dir):
    """A complete result over two batches: the last one holds every window once."""
    e, _ = _ended(spark, sf_dir)
    done = _drained(S.counts(_in_turn(spark, [e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")])), "complete")
    return done.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def stream_sessions(spark, sf_dir):
    rows = _drained(S.sessions(_in_turn(spark, list(_ended(spark, sf_dir)))), "append")
    return rows.where("user_id is not null").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


def stream_retain(spark, sf_dir):
    """Recognitions of even ids, then those of odd ones, under retention by number and age."""
    h = policies._stored(spark, sf_dir)
    path = shared(spark, "history")
    _run(_in_turn(spark, [h.where("id % 2 = 0"), h.where("id % 2 = 1")]), "append", path, S.retain(f"{path}/versions", 500, 15 * 86_400_000))
    return S.latest(spark, f"{path}/versions", h.schema)


def stream_recognize(spark, sf_dir):
    """Captures that arrive in two batches, passed by a gate and recognised batch by batch; their matches become a history with ids."""
    captures = vectors.captures(spark, sf_dir)
    index = vectors.index_of(spark, sf_dir)
    keys = ["capture_id", "track_id", "score", "offset"]
    kinds = spark.createDataFrame([], "capture_id bigint, track_id bigint, score double, offset int").schema
    path = shared(spark, "matches")
    gated = _in_turn(spark, [captures.where("capture_id % 2 = 0"), captures.where("capture_id % 2 = 1")]).where("capture_id % 5 <> 4")
    _run(gated, "append", path, S.recognised(lambda batch: index.recognize_embeddings(batch).withColumn("offset", F.col("offset").cast("int")), f"{path}/out", kinds))
    found = spark.read.schema(kinds).option("basePath", f"{path}/out").parquet(f"{path}/out").select(*keys)
    history = spark.createDataFrame([], "id bigint, track_id string, recognized_at_ms bigint, score double, offset int")
    rows = found.select(F.col("track_id").cast("string").alias("track_id"), (F.col("capture_id") * 1000).alias("recognized_at_ms"), "score", "offset")
    return policy.insert(history, rows)


QUERIES = {f.__name__: f for f in (stream_squelch, stream_projection, stream_expiry, stream_window_counts, stream_late_counts, stream_running_counts, stream_sessions, stream_retain, stream_recognize)}
ORACLES = {
    "stream_squelch": _SQUELCH.format(adapt=5 * 86_400_000).replace("SELECT user_id, event_id, squelch_ms, squelch_ms + 4000 AS next_delay_ms FROM c", """, s AS (SELECT user_id, event_id, ts, sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM events),
dep AS (SELECT user_id, event_id, (s - least(min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0))::BIGINT AS depth FROM s)
SELECT c.user_id, c.event_id, squelch_ms, squelch_ms + 4000 AS next_delay_ms, depth FROM c JOIN dep USING (event_id)"""),
    "stream_projection": policies.ORACLES["projected_previous"].replace("72000000", str(40 * DAY)),
    "stream_expiry": """WITH s AS (SELECT user_id, event_id, ts, sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM events),
dep AS (SELECT user_id, event_id, ts, (s - least(min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0))::BIGINT AS depth FROM s)
SELECT user_id, 55000::BIGINT AS squelch_ms, NULL::BIGINT AS match_id, arg_max(depth, (ts, event_id)) AS depth FROM dep GROUP BY user_id""",
    "stream_window_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_late_counts": "SELECT event_type, count(*) AS windows, sum(n)::BIGINT AS n FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type",
    "stream_running_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_retain": policies._H + """, a AS (SELECT * FROM stored WHERE id % 2 = 0), first AS (SELECT * FROM a WHERE recognized_at_ms >= (SELECT arg_max(recognized_at_ms, id) FROM a) - 1296000000 ORDER BY recognized_at_ms DESC, id DESC LIMIT 500),
b AS (SELECT * FROM first UNION ALL SELECT * FROM stored WHERE id % 2 = 1) SELECT * FROM b WHERE recognized_at_ms >= (SELECT arg_max(recognized_at_ms, id) FROM b) - 1296000000 ORDER BY recognized_at_ms DESC, id DESC LIMIT 500""",
    "stream_recognize": vectors._SEQ + """, found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY rank) AS n FROM sequences WHERE score > 100) WHERE n = 1 AND capture_id % 5 <> 4)
SELECT row_number() OVER (ORDER BY capture_id, track_id) AS id, track_id::VARCHAR AS track_id, capture_id * 1000 AS recognized_at_ms, score, "offset"::INT AS "offset" FROM found""",
    "stream_sessions": """SELECT user_id, count(*) FILTER (gap) AS sessions, count(*) AS events FROM (SELECT user_id, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR, true) AS gap FROM events) GROUP BY user_id""",
}
