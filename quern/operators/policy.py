"""Event policy: back-off after recognitions, the former match as it would stand now, gates, and retention of history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scalars import clamp, round_half_up

PRE_EVENT_MS, FALLBACK_MS, EXPIRE_MS, ADAPT_MS = 4_000, 55_000, 1_200_000, 720_000
MISSES, MISSES_MS = 10, 90_000
PADDING_MS, HEURISTIC_MS, INPUT_MS, LEAST_MS, MOST_MS, FLOOR_MS, CEILING_MS = 5_000, 50_000, 8_000, 20_000, 90_000, 15_000, 180_000
KEEP_ROWS, KEEP_MS = 1_000, 2_592_000_000


def matched_squelch(duration_ms: Column, offset_ms: Column, elapsed_ms: Column) -> Column:
    remaining = duration_ms - INPUT_MS - round_half_up(offset_ms, 2_000) - F.greatest(elapsed_ms, F.lit(0))
    near = clamp(remaining + PADDING_MS, LEAST_MS, MOST_MS)
    return F.when(duration_ms.isNull() | offset_ms.isNull(), FALLBACK_MS).when(remaining < HEURISTIC_MS, near).otherwise(FALLBACK_MS)


def squelch(history: DataFrame, adapt_ms: int = ADAPT_MS) -> DataFrame:
    """Decides at the time of each event, from the events of its key up to it (itself included).

    history: user_id, event_id, at_ms, matched, offset_ms, duration_ms; adds squelch_ms, next_delay_ms. Of events at one time
    all count, and the newest is the last by event_id.
    """
    recent = Window.partitionBy("user_id").orderBy("at_ms").rangeBetween(-adapt_ms, 0)
    rows = history.withColumns({"_n": F.count("*").over(recent), "_any": F.bool_or("matched").over(recent)})
    newest = Window.partitionBy("user_id").orderBy("at_ms").rangeBetween(0, 0)
    last = F.max(F.struct("event_id", "matched", "duration_ms", "offset_ms")).over(newest)
    rows = rows.withColumn("_last", last)
    wait = (
        F.when(~F.col("_any"), F.when(F.col("_n") >= MISSES, MISSES_MS).otherwise(FALLBACK_MS))
        .when(~F.col("_last.matched"), FALLBACK_MS)
        .otherwise(matched_squelch(F.col("_last.duration_ms"), F.col("_last.offset_ms"), F.lit(0)))
    )
    wait = clamp(wait, FLOOR_MS, CEILING_MS).cast("bigint")
    return rows.withColumns({"squelch_ms": wait, "next_delay_ms": wait + PRE_EVENT_MS}).drop("_n", "_any", "_last")


def projected_previous(history: DataFrame, expire_ms: int = EXPIRE_MS) -> DataFrame:
    """At each event, the latest earlier match of its key within ``expire_ms``, its offset moved on by the time since."""
    before = Window.partitionBy("user_id").orderBy("at_ms", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    match = F.when(F.col("matched"), F.struct("at_ms", "event_id", "offset_ms"))
    rows = history.withColumn("_m", F.last(match, ignorenulls=True).over(before))
    since = F.col("at_ms") - F.col("_m.at_ms")
    return rows.where(since.between(0, expire_ms)).select("user_id", "event_id", "at_ms", F.col("_m.event_id").alias("match_id"), ((F.col("_m.offset_ms") + since) / 1000.0).alias("offset_seconds"))


def rearm_delay(squelch_ms: Column, elapsed_ms: Column) -> Column:
    return F.greatest(squelch_ms - elapsed_ms, F.lit(0))


def on_demand_depth(events: DataFrame) -> DataFrame:
    """Nested sessions after each event (+1 begins, -1 ends), never below zero: the running sum less its least value so far, where that is negative."""
    w = Window.partitionBy("user_id").orderBy("at_ms", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    run = events.withColumn("_s", F.sum("step").over(w))
    return run.withColumn("depth", F.col("_s") - F.least(F.min("_s").over(w), F.lit(0))).drop("_s")


def newest_first(history: DataFrame, limit: int = KEEP_ROWS) -> DataFrame:
    return history.orderBy(F.desc("recognized_at_ms"), F.desc("id")).limit(limit)


def pruned(history: DataFrame, keep_rows: int = KEEP_ROWS, keep_ms: int = KEEP_MS) -> DataFrame:
    """Rows no older than ``keep_ms`` before the row inserted last (greatest id), and of them the newest ``keep_rows``.

    The cut-off is one aggregated row and the newest rows are one top-k, so no task sorts the table.
    """
    now = history.agg(F.max_by("recognized_at_ms", "id").alias("_now"))
    fresh = history.join(F.broadcast(now), F.col("recognized_at_ms") >= F.col("_now") - keep_ms).drop("_now")
    return newest_first(fresh, keep_rows)


def insert(history: DataFrame, rows: DataFrame, fan: int = 4096) -> DataFrame:
    """Appends rows without an id, numbered from the greatest id on in order of time.

    Rows are counted by ranges of time first, at most ``fan``, so only the counts are ordered in one task.
    """
    top = history.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    span = rows.agg(F.min("recognized_at_ms").alias("_lo"), F.max("recognized_at_ms").alias("_hi"))
    ranged = rows.crossJoin(F.broadcast(span)).withColumn("_b", F.floor((F.col("recognized_at_ms") - F.col("_lo")) * fan / (F.col("_hi") - F.col("_lo") + 1))).drop("_lo", "_hi")
    before = F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    base = ranged.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", F.coalesce(before, F.lit(0)).alias("_before"))  # fan rows at most
    order = F.row_number().over(Window.partitionBy("_b").orderBy("recognized_at_ms", "track_id"))
    new = ranged.withColumn("_r", order).join(F.broadcast(base), "_b").crossJoin(F.broadcast(top))
    return history.unionByName(new.withColumn("id", F.col("_top") + F.col("_before") + F.col("_r")).select(*history.columns))


def delete(history: DataFrame, id: int) -> DataFrame:
    return history.where(F.col("id") != id)


def remove(history: DataFrame, id: int) -> tuple[DataFrame, DataFrame]:
    """The history without a row, and one row that says how many went (``gone``)."""
    return delete(history, id), history.agg(F.count_if(F.col("id") == id).alias("gone"))


def clear(history: DataFrame) -> tuple[DataFrame, DataFrame]:
    return history.where(F.lit(False)), history.agg(F.count("*").alias("gone"))


#: Reason and condition on a state row, in the order in which they are asked.
BLOCKS: tuple[tuple[str, str], ...] = (
    ("an on-demand session is active", "on_demand > 0"),
    ("the app user is not foreground", "NOT coalesce(user_foreground, false)"),
    ("the main user is not foreground", "NOT coalesce(main_user_foreground, true)"),
    ("phone state is unavailable", "call_state IS NULL"),
    ("a phone call is active", "call_state <> 0"),
    ("AudioManager is unavailable", "recordings IS NULL"),
    ("another audio recording is active", "recordings > 0"),
)


def block_reason(blocks: tuple[tuple[str, str], ...] = BLOCKS) -> Column:
    """The first reason whose condition holds, else null."""
    return F.coalesce(*(F.when(F.expr(c), F.lit(r)) for r, c in blocks))


#: Prefixes of packages whose playback doesn't count.
IGNORED = ("ak.alizandro.smartaudiobookplayer", "com.breel.wallpapers", "com.google.android.googlequicksearchbox")


def music_playback(package: Column, usage: Column, content: Column, state: Column, ignored: tuple[str, ...] = IGNORED) -> Column:
    """A started player (2) of media (1) music (2) outside ignored packages."""
    skip = F.lit(False)
    for p in ignored:
        skip = skip | package.startswith(p)
    return ~F.coalesce(skip, F.lit(False)) & (usage == 1) & (content == 2) & (state == 2)
