"""Distributed union-find: connected components by rounds of stars.

Each round brings the edges of a node together; whatever meets in a task is joined by union-find there, and every node
of it is tied to the least one. Edges that meet nothing new are not sent on, so that a forest of stars comes back as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import drop, save

#: Edges joined at once in a task, and the edges of one node beyond which they are dealt to several tasks: so many, or 1 in 2 ** SHARE if that is more.
CHUNK = 1 << 19
HOT, SHARE = 1 << 10, 12
EDGES = "hi bigint, lo bigint, live boolean"


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes in order, and the least node that each reaches over the edges a[i] - b[i]."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while True:
        x, y = up[a], up[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[up]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up[up] != up).any():
            up = up[up]


def _edges(hi: np.ndarray, lo: np.ndarray, live: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo), pa.array(np.full(len(hi), live))], ["hi", "lo", "live"])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of each chunk as stars."""
    held: list[pa.RecordBatch] = []
    size = 0

    def flush() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        nodes, least = least_reachable(t.column(0).to_numpy(), t.column(1).to_numpy())
        tied = nodes != least
        return _edges(nodes[tied], least[tied], True)

    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= CHUNK:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows u, s, v sorted so, each edge under both its ends: new edges, ``live`` if a node of the chunk had more than one smaller neighbour, or smaller and larger ones."""
    held: list[pa.RecordBatch] = []
    size = 0
    carry: tuple[int, int, int] | None = None  # the last group, and its least neighbour

    def flush() -> pa.RecordBatch:
        nonlocal carry
        t = pa.Table.from_batches(held)
        u, s, v = (t.column(c).to_numpy() for c in range(3))
        if carry and carry[:2] == (u[0], s[0]):
            u, s, v = (np.insert(x, 0, c) for x, c in zip((u, s, v), carry, strict=True))
        first = np.insert((u[1:] != u[:-1]) | (s[1:] != s[:-1]), 0, True)
        fresh = first | np.insert(v[1:] != v[:-1], 0, True)  # repeated edges are adjacent
        at = np.flatnonzero(first)
        carry = int(u[-1]), int(s[-1]), int(v[at[-1]])
        u, v, begin = u[fresh], v[fresh], np.flatnonzero(first[fresh])
        less = np.add.reduceat((v < u).astype(np.int64), begin)
        more = np.add.reduceat((v > u).astype(np.int64), begin)
        live = bool(((less > 1) | ((less > 0) & (more > 0))).any())
        nodes, least = least_reachable(u, v)
        own = np.unique(u)
        known = least[np.searchsorted(nodes, v)] == u  # a neighbour that its own task ties to u as well
        tied = nodes != least
        tied &= np.isin(nodes, own, assume_unique=True) | ~np.isin(nodes, v[known])
        return _edges(nodes[tied], least[tied], live)

    for batch in batches:
        if len(batch):
            held.append(batch)
            size += len(batch)
        if size >= CHUNK:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def _hot(edges: DataFrame) -> dict[int, int]:
    """Nodes with so many larger neighbours that one task shouldn't take them all, at most 2 ** SHARE of them, and the number of tasks for each."""
    n = edges.count()
    limit = max(HOT, n >> SHARE)
    if n <= limit:
        return {}
    rows = edges.groupBy("lo").count().where(F.col("count") > limit).collect()
    return {r["lo"]: -(-r["count"] // limit) for r in rows}


def _round(edges: DataFrame, hot: dict[int, int]) -> DataFrame:
    ids = np.array(sorted(hot), np.int64)
    tasks = np.array([hot[i] for i in ids.tolist()], np.int64)
    shared = edges.sparkSession.sparkContext.broadcast((ids, tasks))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Larger neighbours of a hot node go to one of its tasks each, smaller ones to all."""
        ids, tasks = shared.value

        def of(x: np.ndarray) -> np.ndarray:
            if not len(ids):
                return np.ones(len(x), np.int64)
            at = np.minimum(np.searchsorted(ids, x), len(ids) - 1)
            return np.where(ids[at] == x, tasks[at], 1)

        for batch in batches:
            hi, lo = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            copies = of(hi)
            s = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
            u, v = np.concatenate([np.repeat(hi, copies), lo]), np.concatenate([np.repeat(lo, copies), hi])
            s = np.concatenate([s, (hi * 0x9E3779B1 >> 16) % of(lo)])
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(s), pa.array(v)], ["u", "s", "v"])

    rows = edges.select("hi", "lo").mapInArrow(deal, "u bigint, s bigint, v bigint")
    return rows.repartition("u", "s").sortWithinPartitions("u", "s", "v").mapInArrow(_meet, EDGES)


def stars(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component), a table in the shared folder, for every node that isn't the least of its component."""
    pairs = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    now = save(pairs.mapInArrow(_contract, EDGES), "edges")
    hot = _hot(now)  # a node that turns hot later is least among what is joined then, and only its task takes longer
    while True:
        new = save(_round(now, hot), "edges")
        drop(now)
        now = new
        if now.where("live").isEmpty():
            out = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
            out.saved_path = now.saved_path
            return out


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node with an edge to another; component is the least node reachable, itself included.

    Nodes are longs. Null ends, loops and repeated edges do no harm. Edges of a hot node are dealt to several tasks, never
    gathered, and each round is a table in the shared folder.
    """
    tied = stars(edges, a, b)
    return tied.unionByName(tied.select(F.col("component").alias("node"), "component").distinct())
