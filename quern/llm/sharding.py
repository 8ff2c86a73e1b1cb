"""Resharding by minimum-cost flow: move the fewest bytes from old shards to new capacities.

Rows are numbered, and those of an old shard fall into blocks by a hash of their number, so that rows equal in all columns
spread as well. The driver sees only block sizes, whose number is bounded by ``max_blocks`` whatever the table's size, and
solves a transport problem: surplus of old shards flows to room in new ones, staying costs nothing, moving costs the
bytes (or a price per pair). Whole blocks then move so as to fill each flow. Shards whose blocks neither leave nor arrive
keep their files; the others are written beside them and put in their place.
"""

from __future__ import annotations

import heapq
import uuid
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.shared import filesystem, save, shared_dir, text_bytes, unused

MAX_BLOCKS = 1 << 16


def min_cost_flow(supply: list[int], room: list[int], price) -> dict[tuple[int, int], int]:
    """Flow (source, sink) -> amount that ships the whole supply at least total price.

    Successive shortest augmenting paths with potentials on the bipartite transport graph; ``price(i, j)`` >= 0.
    """
    assert sum(supply) <= sum(room)
    n, m = len(supply), len(room)
    flow: dict[tuple[int, int], int] = defaultdict(int)
    left, free = list(supply), list(room)
    cost = [[price(i, j) for j in range(m)] for i in range(n)]
    pot = [0.0] * (n + m)
    while any(left):
        dist: list[float] = [float("inf")] * (n + m)
        back: list[int] = [-1] * (n + m)
        heap = []
        for i in range(n):
            if left[i]:
                dist[i] = 0.0
                heapq.heappush(heap, (0.0, i))
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            edges = ((n + j, cost[u][j]) for j in range(m)) if u < n else ((i, -cost[i][u - n]) for i in range(n) if flow[i, u - n] > 0)
            for v, c in edges:
                reduced = d + c + pot[u] - pot[v]
                if reduced < dist[v] - 1e-9:
                    dist[v], back[v] = reduced, u
                    heapq.heappush(heap, (reduced, v))
        end = min((n + j for j in range(m) if free[j]), key=lambda v: dist[v] + pot[v])
        pot = [p + min(d, dist[end]) for p, d in zip(pot, dist, strict=True)]
        path = [end]
        while back[path[-1]] >= 0:
            path.append(back[path[-1]])
        path.reverse()
        amount = min([left[path[0]], free[end - n], *(flow[v, u - n] for u, v in zip(path, path[1:], strict=False) if u >= n)])
        for u, v in zip(path, path[1:], strict=False):
            if u < n:
                flow[u, v - n] += amount
            else:
                flow[v, u - n] -= amount
        left[path[0]] -= amount
        free[end - n] -= amount
    return {k: v for k, v in flow.items() if v}


def plan_moves(blocks: dict[tuple[int, int], int], shards: int, price=None) -> dict[tuple[int, int], int]:
    """New shard of each (old shard, block), given block sizes in bytes.

    Capacities are the mean size. An old shard at or above ``shards`` must move entirely. No block gives no moves.
    """
    have: dict[int, int] = defaultdict(int)
    for (s, _), b in blocks.items():
        have[s] += b
    total = sum(have.values())
    capacity = [total // shards + (j < total % shards) for j in range(shards)]
    price = price or (lambda i, j: 1)
    olds = sorted({*have, *range(shards)})
    supply = [max(0, have[s] - (capacity[s] if 0 <= s < shards else 0)) for s in olds]
    room = [max(0, capacity[j] - have[j]) for j in range(shards)]
    flows = min_cost_flow(supply, room, lambda i, j: price(olds[i], j))

    target = {k: k[0] for k in blocks}
    size = {j: have[j] for j in range(shards)}
    rest = {s: sorted(((b, k) for (o, k), b in blocks.items() if o == s), reverse=True) for s in olds}
    for (i, j), amount in sorted(flows.items(), key=lambda x: -x[1]):
        s, stay = olds[i], []
        for b, k in rest[s]:  # largest first: whatever still fits goes
            if b <= amount:
                target[s, k] = j
                amount -= b
                size[j] += b
                size[s] = size.get(s, 0) - b
            else:
                stay.append((b, k))
        rest[s] = stay
    for s in olds:  # what may not stay goes where most room is
        if not 0 <= s < shards:
            for b, k in rest[s]:
                j = min(size, key=lambda x: (size[x], x)) if shards else 0
                target[s, k] = j
                size[j] += b
    # The few blocks too large for what was left of their flows: from the fullest to the emptiest while that evens them.
    own = defaultdict(list)
    for (s, k), j in target.items():
        if blocks[s, k]:
            own[j].append((blocks[s, k], s, k))
    for x in own.values():
        x.sort()
    while shards:  # every move lessens the sum of squares, so this ends
        hi, lo = max(range(shards), key=lambda j: (size[j], -j)), min(range(shards), key=lambda j: (size[j], j))
        gap = size[hi] - size[lo]
        best = max((x for x in own[hi] if 2 * x[0] <= gap), default=None) or min((x for x in own[hi] if x[0] < gap), default=None)
        if best is None:
            break
        own[hi].remove(best)
        own[lo].append(best)
        size[hi] -= best[0]
        size[lo] += best[0]
        target[best[1], best[2]] = lo
    return target


def _block(rows: DataFrame, old: str, max_blocks: int, *number: Column) -> Column:
    """The block of a row in its old shard, from what numbers it: together about ``max_blocks``."""
    olds = rows.select(old).distinct().count()
    return F.pmod(F.xxhash64(*number), F.lit(max(1, max_blocks // max(1, olds)))).cast("int")


def _sums(rows: DataFrame, old: str, size: str) -> dict[tuple[int, int], tuple[int, int]]:
    """Bytes and rows of each block, at the driver."""
    found = rows.groupBy(old, "block").agg(F.sum(size).alias("b"), F.count("*").alias("n")).collect()
    return {(r[old], r["block"]): (r["b"], r["n"]) for r in found}


def reshard(rows: DataFrame, old_shard: str, size: str, shards: int, max_blocks: int = MAX_BLOCKS, price=None) -> DataFrame:
    """``rows`` with ``shard`` (its new shard), ``slot`` (gapless from 0 there), ``moved`` and ``block``; columns of those names are replaced.

    ``old_shard`` (int; null: 0) is the shard that holds a row now, ``size`` its bytes (null or negative: 0). The rows
    are saved with a number each, so hand over narrow ones: what identifies a row, and these two. Nulls and repeated
    rows do no harm. Blocks per old shard are ``max_blocks`` divided by the number of old shards, so at most
    ``max_blocks`` sums reach the driver. An empty table stays empty.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    rest = [c for c in rows.columns if c not in ("shard", "slot", "moved", "block")]
    at, old, own, n, place, to, begin = unused([*rest, "shard", "slot", "moved", "block"], "_row", "_old", "_size", "_n", "_place", "_to", "_begin")
    named = {at: F.monotonically_increasing_id(), old: F.coalesce(F.col(f"`{old_shard}`").cast("int"), F.lit(0)), own: F.greatest(F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)), F.lit(0))}
    rows = save(rows.select(*(f"`{c}`" for c in rest)).withColumns(named), "sizes")
    rows = rows.withColumn("block", _block(rows, old, max_blocks, F.col(at)))
    sums = _sums(rows, old, own)
    target = plan_moves({k: b for k, (b, _) in sums.items()}, shards, price)
    first, filled = {}, defaultdict(int)
    for k, (_, count) in sorted(sums.items()):
        first[k] = filled[target[k]]
        filled[target[k]] += count
    table = [(o, k, j, first[o, k]) for (o, k), j in target.items()]  # max_blocks rows at most
    moves = rows.sparkSession.createDataFrame(table, f"{n} int, {place} int, {to} int, {begin} long")
    ranked = rows.withColumn("slot", F.row_number().over(Window.partitionBy(old, "block").orderBy(at)) - 1)
    out = ranked.join(F.broadcast(moves), (F.col(old) == F.col(n)) & (F.col("block") == F.col(place)))
    return out.select(*(f"`{c}`" for c in rest), F.col(to).alias("shard"), (F.col(begin) + F.col("slot")).alias("slot"), (F.col(to) != F.col(old)).alias("moved"), "block")


def write_shards(rows: DataFrame, shard: str, path: str) -> None:
    """A store: the rows as Parquet files in path/shard=j. ``shard`` must be no column that they keep."""
    others = [F.col(f"`{c}`") for c in rows.columns if c not in (shard, "shard")]
    rows.select(*others, F.coalesce(F.col(f"`{shard}`").cast("int"), F.lit(0)).alias("shard")).write.option("compression", "zstd").partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """A store's rows with ``shard``, the place of each in its file, and the file's name as _file and _at."""
    kept = spark.read.parquet(path)
    file, at = unused(kept.columns, "_file", "_at")
    return kept.withColumns({file: F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), at: F.col("_metadata.row_index")})


def rewrite(spark: SparkSession, path: str, shards: int, size: Column, max_blocks: int = MAX_BLOCKS, price=None) -> dict[int, bool]:
    """Bring a store of :func:`write_shards` to ``shards`` even shards, moving the fewest bytes; whether each shard, old or new, was rewritten.

    Rows are known by their file and place, so keys may be null or repeat. ``size`` gives a row's bytes. Only shards that rows
    leave or reach are written, beside the store in path/_new, and only rows that change their shard are shuffled; then
    each shard takes its old one's place, and those that are empty or no longer exist go. Files of untouched shards stay
    as they are, byte for byte. An empty store stays empty.
    """
    files, make = filesystem(spark, path)
    if not len(files.globStatus(make(f"{path}/shard=*")) or []):
        return {}
    whole = read_shards(spark, path)
    names, (file, at) = whole.columns[:-2], whole.columns[-2:]
    block, own, old, place, to, parts = unused(whole.columns, "block", "_bytes", "_old", "_place", "_to", "_parts")
    numbered = whole.withColumn(block, _block(whole, "shard", max_blocks, F.col(file), F.col(at)))
    sums = _sums(numbered.select("shard", F.col(block).alias("block"), size.alias(own)), "shard", own)
    target = plan_moves({k: b for k, (b, _) in sums.items()}, shards, price)
    fate = {j: False for j in {k[0] for k in sums} | set(target.values())}
    count: dict[int, int] = defaultdict(int)
    for k, j in target.items():
        count[j] += sums[k][1]
        if j != k[0]:
            fate[k[0]] = fate[j] = True
    touched = sorted(j for j, changed in fate.items() if changed)
    if not touched:
        return fate
    table = [(o, k, j, -(-count[j] // ROWS)) for (o, k), j in target.items()]  # max_blocks rows at most
    moves = spark.createDataFrame(table, f"{old} int, {place} int, {to} int, {parts} int")
    rows = numbered.where(F.col("shard").isin(touched)).join(F.broadcast(moves), (F.col("shard") == F.col(old)) & (F.col(block) == F.col(place)))
    arriving = rows.where(F.col(to) != F.col("shard")).repartition(to, F.pmod(F.xxhash64(file, at), F.col(parts)))
    both = rows.where(F.col(to) == F.col("shard")).unionByName(arriving)
    both.select(*(F.col(to).alias(c) if c == "shard" else F.col(f"`{c}`") for c in names)).write.option("compression", "zstd").partitionBy("shard").parquet(f"{path}/_new")
    for j in touched:
        now, made = make(f"{path}/shard={j}"), make(f"{path}/_new/shard={j}")
        if files.exists(now):
            files.rename(now, make(f"{path}/_old-{j}"))
        if files.exists(made):
            files.rename(made, now)
        files.delete(make(f"{path}/_old-{j}"), True)
    files.delete(make(f"{path}/_new"), True)
    return fate


#: Rows of a shard that one task writes.
ROWS = 1 << 16


def slots(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """``columns`` of a store's rows with ``shard`` and ``slot``, gapless from 0 there: files by name, and rows by their place in them."""
    rows = read_shards(spark, path)
    file, at = rows.columns[-2:]
    each = rows.groupBy("shard", file).agg(F.count("*").alias("_rows"))  # one row for each file
    begin = each.withColumn("_begin", F.sum("_rows").over(Window.partitionBy("shard").orderBy(file)) - F.col("_rows")).drop("_rows")
    return rows.join(begin.hint("merge"), ["shard", file]).select(*(F.col(f"`{c}`") for c in columns), "shard", (F.col("_begin") + F.col(at)).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Query op4. The store to begin with has one shard for each crc32(source) modulo ``shards``, which a hot source makes uneven; it is rewritten, and its files are read.

    The law is ``bytes``: shard sizes come out near equal. A null text counts 1 byte and has the checksum of no bytes; a null
    source is an empty one. Equal texts need not meet in a shard.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    rows = docs.select("doc_id", text.alias("text"), (F.crc32(F.coalesce(source, F.lit("")).cast("binary")) % shards).cast("int").alias("old_shard"))
    write_shards(rows.withColumn("was", F.col("old_shard")), "old_shard", path)
    if not rewrite(spark, path, shards, text_bytes() + 1):  # an empty table
        return rows.select("doc_id", F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("text_crc32"), F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard", F.lit(False).alias("moved")).where("false")
    checksum = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    done = slots(spark, path, ["doc_id", "text", "was"])
    return done.select("doc_id", (text_bytes() + 1).alias("size"), checksum.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("was").alias("old_shard"), (F.col("shard") != F.col("was")).alias("moved"))
