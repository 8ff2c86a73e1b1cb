"""The event policy over streams: keyed state with expiry, windows of counts, and retention by batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.operators import policy as P


def decide(history: list[tuple], now: int, adapt_ms: int = P.ADAPT_MS, expire_ms: int = P.EXPIRE_MS) -> int:
    """Milliseconds to wait after the events (at, event_id, matched, offset, duration) of one key, as of ``now``."""
    kept = [h for h in history if 0 <= now - h[0] <= expire_ms]
    wait = P.FALLBACK_MS
    if kept:
        newest = max(kept)
        recent = [h for h in kept if 0 <= newest[0] - h[0] <= adapt_ms]
        if not any(h[2] for h in recent):
            wait = P.MISSES_MS if len(recent) >= P.MISSES else P.FALLBACK_MS
        elif newest[2] and newest[3] is not None and newest[4] is not None:
            grid = (newest[3] + 1000) // 2000 * 2000
            left = newest[4] - P.INPUT_MS - grid - max(now - newest[0], 0)
            if left < P.HEURISTIC_MS:
                wait = min(max(left + P.PADDING_MS, P.LEAST_MS), P.MOST_MS)
    return min(max(wait, P.FLOOR_MS), P.CEILING_MS)


OUT = "user_id bigint, event_id bigint, at_ms bigint, squelch_ms bigint, next_delay_ms bigint, match_id bigint, offset_seconds double, depth bigint"
STATE = "events array<struct<at_ms:bigint,event_id:bigint,matched:boolean,offset_ms:bigint,duration_ms:bigint>>, match_at bigint, match_id bigint, match_offset bigint, depth bigint"


def squelch_stream(events: DataFrame, adapt_ms: int = P.ADAPT_MS, expire_ms: int = P.EXPIRE_MS) -> DataFrame:
    """For each event of a stream its back-off and the former match as projected to it, in order of time within a batch.

    events: user_id, event_id, ts (timestamp, with a watermark), at_ms, matched, offset_ms, duration_ms, step. State of a key keeps
    only unexpired events and the last match, and is dropped when the watermark passes its expiry; events later than
    the watermark's delay are dropped by Spark.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, match_at, match_id, match_offset, depth = state.get if state.exists else ([], None, None, None, 0)
        held = [tuple(h) for h in held]
        rows = pd.concat(list(batches)).sort_values(["at_ms", "event_id"])
        out = []
        clean = lambda x: None if x is None or pd.isna(x) else int(x)
        for r in rows.itertuples(index=False):
            now = int(r.at_ms)
            projected, source = None, None
            if match_at is not None and 0 <= now - match_at <= expire_ms:
                projected, source = (match_offset + now - match_at) / 1000.0, match_id
            held.append((now, int(r.event_id), bool(r.matched), clean(r.offset_ms), clean(r.duration_ms)))
            held = [h for h in held if 0 <= now - h[0] <= expire_ms]
            if r.matched and clean(r.offset_ms) is not None:
                match_at, match_id, match_offset = now, int(r.event_id), clean(r.offset_ms)
            depth = max(depth + int(r.step), 0)
            wait = decide(held, now, adapt_ms, expire_ms)
            out.append((key[0], int(r.event_id), now, wait, wait + P.PRE_EVENT_MS, source, projected, depth))
        state.update((held, match_at, match_id, match_offset, depth))
        newest = max(h[0] for h in held)
        state.setTimeoutTimestamp(max(newest + expire_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in OUT.split(", ")]).astype({"match_id": "Int64"})

    return events.groupBy("user_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def counts(events: DataFrame, size: str = "1 day", slide: str | None = None, delay: str = "2 days") -> DataFrame:
    """Events by type in windows of event time, tumbling or sliding; late ones beyond ``delay`` are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", delay).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "6 hours", delay: str = "2 days") -> DataFrame:
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", delay).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "user_id", "n")


def retain(path: str, keep_rows: int = P.KEEP_ROWS, keep_ms: int = P.KEEP_MS):
    """A foreachBatch function: appends a batch to the history at ``path`` and keeps what retention allows, as a new version beside the old.

    Versions are numbered by the batch, so a batch that runs again writes the same version. The one before stays, for a batch that
    is repeated; older ones are deleted.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(batch.schema).parquet(f"{path}/v{epoch - 1}") if epoch else batch.limit(0)
        P.pruned(before.unionByName(batch), keep_rows, keep_ms).write.mode("overwrite").parquet(f"{path}/v{epoch}")
        make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        files = make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.delete(make(f"{path}/v{epoch - 2}"), True)

    return write


def latest(spark: SparkSession, path: str, schema) -> DataFrame:
    """The newest version that :func:`retain` wrote; no rows if there is none."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [int(f.getPath().getName()[1:]) for f in (files.globStatus(make(f"{path}/v*")) or [])]
    return spark.read.schema(schema).parquet(f"{path}/v{max(found)}") if found else spark.createDataFrame([], schema)


def recognised(recognise: Callable[[DataFrame], DataFrame], path: str, schema) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for a stream of gated captures: each batch is recognised as a whole and its matches are stored under ``path``.

    ``recognise`` takes the batch's rows. A batch that is repeated after a failure replaces its own matches.
    """
    names = [f.name for f in schema]

    def write(batch: DataFrame, epoch: int) -> None:
        recognise(batch).select(*names).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write
