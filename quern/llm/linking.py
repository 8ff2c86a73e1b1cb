"""Links between similar items by banded signatures, without emitting all pairs of a bucket.

An item has a signature of 16-bit registers. Items that agree in all registers of a band share a bucket.

1. Each member of a bucket is compared with one hub: the member that shares most buckets, which in a group of edited
   copies is the one nearest to all. Hubs are chosen where a bucket's keys meet, first among the members of one chunk,
   then among the chunks' hubs, so that rows grow with the members, not with their pairs, and no join is needed.
2. Components of the links found so far tell which buckets, of three members or more, still hold members of different
   components. There, inside a task and in blocks of bounded size, signatures tell which members may have a link to
   another component at all, pairs apart that were compared already.
3. Only these are compared again, hub by hub. Most of a hub's members are in one component by now; the others, its
   outliers, are compared with everyone by their whole sets, block against block, and what leaves a task is a forest
   over components. After this no pair of a bucket is left open.

Signatures are joined by shuffled hash at every size, held as one row for each item, never the rows of a hot item; how
texts are joined is up to ``attach``. So the plan does not turn from broadcasting to shuffling as tables grow.
Candidates are always settled by ``verifier`` or ``cell_links`` on the items' whole content.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import words as W
from quern.llm.components import stars
from quern.llm.shared import drop, save

BLOCK = 1024
PAIRS = 1 << 16
CELL_BYTES = 2_000_000
SALTS = 16  #: tasks that share the members of a hub where they get their blocks
EMPTY = np.uint16(0xFFFF)


def registers(column: pa.Array, m: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, m), np.uint16)
    _, offsets, data = column.buffers()  # no nulls, and all of one size
    begin = int(np.frombuffer(offsets, np.int32)[column.offset])
    return np.frombuffer(data, np.uint16, len(column) * m, begin).reshape(len(column), m)


def _band_keys(sig: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (n, bands) and which of them are of a band that isn't empty."""
    n, m = sig.shape
    sig = sig[:, : m // rows * rows].reshape(n, m // rows, rows)
    full = np.zeros(sig.shape[:2], bool)
    key = np.zeros(sig.shape[:2], W.U)
    for r in range(rows):
        one = sig[:, :, r]
        full |= one != EMPTY
        key = (W.mix(key) if r % 4 == 0 and r else key << W.U(16)) + one  # four registers fill a number
    return W.mix(W.mix(key) + np.arange(m // rows, dtype=W.U) * W.U(0xD6E8FEB86659FD93)), full


CHUNK = 1 << 20
PACK = "p int, kind int, keys binary, ids binary, more binary"
MEMBERS = "key bigint, id bigint, hub bigint, pair boolean"


def _leads(keys: np.ndarray, ids: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries by key, in each the one of most weight first, then of least id: their order, which of them are first, and the group of each."""
    order = np.lexsort((ids, -weight.astype(np.int64), keys))
    k = keys[order]
    first = np.insert(k[1:] != k[:-1], 0, True)
    return order, first, np.cumsum(first) - 1


def _member_rows(keys: np.ndarray, ids: np.ndarray, hubs: np.ndarray, pair: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in (keys, ids, hubs)), pa.array(pair)], ["key", "id", "hub", "pair"])


def bucket_members(items: DataFrame, m: int, rows: int) -> DataFrame:
    """(key, id, hub, pair) of every bucket with two members or more; hub is the member that id is to be compared with, itself for the bucket's hub; a pair is known to have no third.

    items: id, sig (binary of m registers), saved. A task sorts its own keys first. Of the members of a bucket that a
    chunk holds, the hub stands for them elsewhere, so that a bucket sends at most one entry per chunk, however large it
    is. Entries travel as packed arrays with the number of buckets shared in their chunk; the parts they are dealt to
    hold about CHUNK entries each.
    """
    total = items.count() * (m // rows)
    bits = max(4, (total // CHUNK).bit_length())

    def pack(keys: np.ndarray, ids: np.ndarray, who: np.ndarray, chunk: int) -> Iterator[dict]:
        keys = keys >> W.U(32 - bits)  # part and 32 more bits
        order = np.argsort(keys)
        keys, ids, who = keys[order], ids[order], who[order]
        begin = np.flatnonzero(np.insert(keys[1:] != keys[:-1], 0, True))
        run = np.diff(np.append(begin, len(keys)))
        size = np.repeat(run, run)
        weight = np.bincount(who, size - 1).astype(np.uint32)[who]
        multi = size > 1
        lead = ~multi
        if multi.any():
            k, i, w = keys[multi], ids[multi], weight[multi]
            order, first, group = _leads(k, i, w)
            lead[np.flatnonzero(multi)[order[first]]] = True
            k, i = k[order], i[order]
            rest, hubs = ~first, i[first][group]
            for a in range(0, len(k), CHUNK // 8):
                cut = slice(a, a + CHUNK // 8)
                own = rest[cut]
                yield {"p": int(k[a] + W.U(chunk)) % (1 << bits), "kind": 0, "keys": k[cut][own].tobytes(), "ids": i[cut][own].tobytes(), "more": hubs[cut][own].tobytes()}
        keys, ids, weight, multi = keys[lead], ids[lead], weight[lead], multi[lead]
        cuts = np.searchsorted(keys >> W.U(32), np.arange((1 << bits) + 1, dtype=W.U))
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[p], cuts[p + 1]
            told = (weight[a:b].astype(np.uint32) << np.uint32(1)) | multi[a:b]  # the lowest bit: stands for several
            yield {"p": p, "kind": 1, "keys": keys[a:b].astype(np.uint32).tobytes(), "ids": ids[a:b].tobytes(), "more": told.astype(np.uint32).tobytes()}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, items, chunk = [], 0, 0, 0
        schema = pa.schema([("p", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary()), ("more", pa.binary())])

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(list(pack(*(np.concatenate(x) for x in zip(*parts, strict=True)), chunk)), schema)

        for batch in batches:
            for i in range(0, len(batch), 4096):
                part = batch.slice(i, 4096)
                key, full = _band_keys(registers(part.column(1), m), rows)
                who = np.nonzero(full)[0]
                parts.append((key[full], part.column(0).to_numpy()[who], who + items))
                held += len(who)
                items += len(part)
                if held >= CHUNK:
                    yield flush()
                    parts, held, items, chunk = [], 0, 0, chunk + 1
        if held:
            yield flush()

    def meet(p: int, keys: list[bytes], ids: list[bytes], more: list[bytes]) -> pa.RecordBatch:
        k = np.frombuffer(b"".join(keys), np.uint32)
        i = np.frombuffer(b"".join(ids), np.int64)
        told = np.frombuffer(b"".join(more), np.uint32)
        by = np.argsort(k)
        twin = k[by][1:] == k[by][:-1]
        keep = (told & 1).astype(bool)
        keep[by[1:][twin]] = keep[by[:-1][twin]] = True
        k, i, told = k[keep], i[keep], told[keep]
        if not len(k):
            return _member_rows(k, i, i, keep[keep])
        order, first, group = _leads(k, i, told)
        k, i, several = k[order], i[order], told[order] & 1
        pair = (np.bincount(group) == 2) & (np.bincount(group, several) == 0)
        return _member_rows(k.astype(np.int64) | (p << 32), i, i[first][group], pair[group])

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[int, list, list, list] | None = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    own = [np.frombuffer(r[c], np.int64) for c in ("keys", "ids", "more")]
                    yield _member_rows(*own, np.zeros(len(own[0]), bool))
                    continue
                if now and now[0] != r["p"]:
                    yield meet(*now)
                    now = None
                now = now or (r["p"], [], [], [])
                now[1].append(r["keys"])
                now[2].append(r["ids"])
                now[3].append(r["more"])
        if now:
            yield meet(*now)

    sent = items.select("id", "sig").mapInArrow(send, PACK)
    return sent.repartition(1 << bits, "p").sortWithinPartitions("p").mapInArrow(receive, MEMBERS)


def _cross_pairs(group: np.ndarray, comp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices i < j of one group and different components, for rows sorted by group and component."""
    n = len(group)
    change = np.flatnonzero((group[1:] != group[:-1]) | (comp[1:] != comp[:-1])) + 1
    ends = np.append(change, n)
    run_end = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
    gends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, n)
    group_end = np.repeat(gends, np.diff(np.concatenate([[0], gends])))
    count = group_end - run_end
    i = 0
    total = np.cumsum(count)
    while i < n:
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PAIRS, side="right")))
        c = count[i:j]
        left = np.repeat(np.arange(i, j), c)
        right = np.arange(len(left)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(run_end[i:j], c)
        if len(left):
            yield left, right
        i = j


def _grouped(batches: Iterator[pa.RecordBatch], by: tuple[str, ...], least: int) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by ``by``, of about ``least`` rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        size += len(batch)
        if size < least:
            continue
        t = pa.Table.from_batches(held)
        same = np.ones(len(t), bool)
        for c in by:
            v = t.column(c).to_numpy()
            same &= v == v[-1]
        cut = int(np.argmax(same))  # the last group may go on
        if cut:
            yield t.slice(0, cut)
            t = t.slice(cut)
        held = t.combine_chunks().to_batches()
        size = len(t)
        least = max(least, 2 * size)
    if held:
        yield pa.Table.from_batches(held)


def _groups(t: pa.Table, by: tuple[str, ...]) -> np.ndarray:
    fresh = np.zeros(len(t), bool)
    for c in by:
        v = t.column(c).to_numpy()
        fresh[1:] |= v[1:] != v[:-1]
    return np.cumsum(fresh)


def open_items(rows: DataFrame, m: int, likely: Callable[..., np.ndarray]) -> DataFrame:
    """(hub, id) of members whose signature may match, by ``likely``, one of another component in a bucket with which it wasn't compared yet.

    rows: key, x, y (block numbers), own (the row's block), hub, tried (with which it was compared), component, id, n, sig; sorted by key, x, y, component.
    """
    by = ("key", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, by, 4 * BLOCK):
            x, y, own, n, ids, tried = (t.column(c).to_numpy() for c in ("x", "y", "own", "n", "id", "tried"))
            sig = registers(t.column("sig"), m)
            needy = np.zeros(len(t), bool)
            for i, j in _cross_pairs(_groups(t, by), t.column("component").to_numpy()):
                ok = ((x[i] == y[i]) | (own[i] != own[j])) & ~(needy[i] & needy[j]) & (tried[i] != ids[j]) & (tried[j] != ids[i])
                i, j = i[ok], j[ok]
                ok = likely(sig[i], n[i], sig[j], n[j])
                needy[i[ok]] = needy[j[ok]] = True
            pairs = np.unique(np.stack([t.column("hub").to_numpy()[needy], ids[needy]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["hub", "id"])

    return rows.mapInArrow(run, "hub bigint, id bigint").distinct()


def _forest(pairs: np.ndarray) -> np.ndarray:
    """Edges that join what ``pairs`` (2, n) join, without cycles."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    out = []
    for a, b in np.unique(pairs, axis=1).T.tolist():
        x, y = find(a), find(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((a, b))
    return np.array(out, np.int64).reshape(-1, 2)


def _common(values: np.ndarray, owner: np.ndarray, n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of each set in ``left`` with each in ``right``; values are distinct within an owner."""
    order = np.argsort(values, kind="stable")
    v, o = values[order], owner[order]
    fresh = np.insert(v[1:] != v[:-1], 0, True)
    col = np.cumsum(fresh) - 1
    often = np.bincount(col) > 1
    keep = often[col]
    col, o = (np.cumsum(often) - 1)[col[keep]], o[keep]
    out = np.zeros((len(left), len(right)), np.float32)
    wide = int(often.sum())
    for a in range(0, wide, 8192):
        i, j = np.searchsorted(col, [a, a + 8192])
        part = np.zeros((n, min(8192, wide - a)), np.float32)
        part[o[i:j], col[i:j] - a] = 1
        out += part[left] @ part[right].T
    return out


def cell_links(rows: DataFrame, sets: Callable[[pa.Array], list[np.ndarray]], percent: int) -> DataFrame:
    """Links (a, b) between components, from cells of two blocks: hub, x, y, own, component, id, text; sorted by hub, x, y."""
    by = ("hub", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, by, 1):
            t = t.combine_chunks()
            group = _groups(t, by)
            comp, own, x, y = (t.column(c).to_numpy() for c in ("component", "own", "x", "y"))
            off = np.append(0, np.cumsum(pc.binary_length(t.column("text")).to_numpy()))
            ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(t)).tolist()
            found = []
            a, done, held = 0, 0, []
            for b in ends:
                if b > done:  # sets of the next cells, of some megabytes together
                    done = max(b, max((e for e in ends if a <= e and off[e] - off[a] <= CELL_BYTES), default=b))
                    held, from_ = sets(t.column("text").slice(a, done - a)), a
                left, right = np.flatnonzero(own[a:b] == x[a]), np.flatnonzero(own[a:b] == y[a])
                if len(left) and len(right):
                    s = held[a - from_ : b - from_]
                    size = np.array([len(z) for z in s])
                    both = _common(np.concatenate(s), np.repeat(np.arange(b - a), size), b - a, left, right)
                    union = size[left][:, None] + size[right] - both
                    i, j = np.nonzero((100 * both >= percent * union) & (union > 0) & (comp[a:b][left][:, None] != comp[a:b][right]))
                    found.append(np.stack([comp[a:b][left[i]], comp[a:b][right[j]]]))
                a = b
            edges = _forest(np.concatenate(found, axis=1)) if found else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def _cells(needy: DataFrame) -> DataFrame:
    """hub, id, component -> the cells in which each is compared: hub, x, y, own, component, id.

    The commonest component of a hub is its core, blocks 0 to c - 1; outliers have the blocks after them. Cells pair every
    block of outliers with every block of the core and of outliers.
    """
    count = needy.groupBy("hub", "component").agg(F.count("*").alias("n"))
    core = count.groupBy("hub").agg(F.max_by("component", F.struct("n", "component")).alias("core"), F.max("n").alias("inside"), F.sum("n").alias("all"))
    blocks = core.select("hub", "core", F.ceil(F.col("inside") / BLOCK).cast("int").alias("c"), F.ceil((F.col("all") - F.col("inside")) / BLOCK).cast("int").alias("o")).where("o > 0")
    dealt = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = needy.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(SALTS)).cast("int")).join(dealt, ["hub", "salt"])
    hashed = F.xxhash64("id")
    own = F.when(F.col("component") == F.col("core"), F.pmod(hashed, F.col("c"))).otherwise(F.col("c") + F.pmod(hashed, F.col("o"))).cast("int")
    rows = rows.withColumn("own", own)
    outliers = F.sequence(F.col("c"), F.col("c") + F.col("o") - 1)
    others = F.when(F.col("own") < F.col("c"), outliers).otherwise(F.sequence(F.lit(0), F.col("c") + F.col("o") - 1))
    rows = rows.withColumn("other", F.explode(others))
    return rows.select("hub", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "component", "id")


def link(items: DataFrame, m: int, rows: int, percent: int, likely: Callable[..., np.ndarray], attach: Callable[[DataFrame], DataFrame], sets: Callable[[pa.Array], list[np.ndarray]], same: DataFrame | None = None) -> DataFrame:
    """(node, component) of all items linked with one of lesser id: 100 * intersection >= percent * union. A table in the shared folder.

    items: id long (unique), n long (size of its set), sig binary; saved. ``attach`` adds ``text`` to rows by their id, ``sets``
    gives the sorted distinct hashes of each text's set, ``same`` (a, b) are items that belong together anyway.
    """
    verify = verifier(attach, sets, percent)
    members = save(bucket_members(items, m, rows), "members")
    star = members.where("id != hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).repartition("a").distinct()
    tried = save(_filtered(star, items, m, likely), "tried")
    links = save(verify(tried), "links")
    first = links if same is None else links.unionByName(same)
    labels = stars(first, "a", "b")

    labelled = labels.withColumnRenamed("node", "id")
    seen = members.where("not pair").drop("pair").join(labelled.hint("shuffle_hash"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = seen.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("size"), F.min("hub").alias("first"))
    mixed = mixed.where("least != most and size > 2").select("key", F.col("first").alias("hub"), F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    rest = seen.withColumnRenamed("hub", "tried").join(mixed, "key").join(items.hint("shuffle_hash"), "id")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    rest = rest.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "hub", "tried", "component", "id", "n", "sig")
    spread = rest.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "component")
    open_ = save(open_items(spread, m, likely), "open")
    needy = open_.join(labelled, "id", "left").withColumn("component", F.coalesce("component", "id"))

    cells = save(_cells(needy), "cells")
    held = attach(cells).select("hub", "x", "y", "own", "component", "id", "text")
    more = save(cell_links(held.repartition("hub", "x", "y").sortWithinPartitions("hub", "x", "y"), sets, percent), "links")
    out = stars(more.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b"))), "a", "b")
    drop(members, tried, links, labels, open_, cells, more)
    return out


def _filtered(pairs: DataFrame, items: DataFrame, m: int, likely: Callable[..., np.ndarray]) -> DataFrame:
    left, right = (items.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("sig").alias(f"s{k}")) for k in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 4096):
                p = batch.slice(i, 4096)
                ok = likely(registers(p.column(3), m), p.column(2).to_numpy(), registers(p.column(5), m), p.column(4).to_numpy())
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(1)], ["a", "b"]).filter(pa.array(ok))

    return pairs.join(left.hint("shuffle_hash"), "a").join(right.hint("shuffle_hash"), "b").select("a", "b", "na", "sa", "nb", "sb").mapInArrow(run, "a bigint, b bigint")


def verifier(attach: Callable[[DataFrame], DataFrame], sets: Callable[[pa.Array], list[np.ndarray]], percent: int, salt: int = 256) -> Callable[[DataFrame], DataFrame]:
    """Settles pairs by the whole sets of their texts: 100 * intersection >= percent * union.

    ``attach`` adds ``text`` to rows by their id. The second item of a pair leads a group; its set is made once for each ``salt``
    pairs or so, and the others stream past it, so that no group is held in memory.
    """

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead: tuple | None = None
        base = np.zeros(0, W.U)
        for batch in batches:
            _, off = W.buffer(batch.column(4))
            for i, j in W.slices(off):
                p = batch.slice(i, j - i)
                found = sets(p.column(4))
                a, b = [], []
                for grp, part, role, one, own in zip(p.column(0).to_pylist(), p.column(1).to_pylist(), p.column(2).to_pylist(), p.column(3).to_pylist(), found, strict=True):
                    if role == 0:
                        if lead != (grp, part):
                            lead, base = (grp, part), own
                        continue
                    if not len(own) or lead != (grp, part):
                        continue
                    small, large = (own, base) if len(own) < len(base) else (base, own)
                    if 100 * len(small) < percent * len(large):
                        continue
                    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    both = int((large[at] == small).sum())
                    if 100 * both >= percent * (len(own) + len(base) - both):
                        a.append(one)
                        b.append(grp)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def verify(pairs: DataFrame) -> DataFrame:
        size = pairs.groupBy("b").agg(F.count("*").alias("c"))
        asked = pairs.join(size, "b").select("a", F.col("b").alias("grp"), F.pmod(F.xxhash64("a"), F.ceil(F.col("c") / salt)).cast("int").alias("part"))
        wanted = asked.select("grp", "part", F.lit(1).alias("role"), F.col("a").alias("id")).unionByName(asked.select("grp", "part", F.lit(0).alias("role"), F.col("grp").alias("id")).distinct())
        rows = attach(wanted).select("grp", "part", "role", "id", "text")
        return rows.repartition("grp", "part").sortWithinPartitions("grp", "part", "role").mapInArrow(settle, "a bigint, b bigint")

    return verify
