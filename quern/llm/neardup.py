"""Near-duplicate documents by HyperMinHash.

A document's set of word shingles is hashed once; the hash picks one of 2 ** 7 buckets, and each bucket keeps the least
remaining value in 16 bits: its count of leading zeros (6 bits) and the 10 mantissa bits that follow. Registers are
banded for candidates; a candidate's Jaccard similarity is estimated from equal registers, less the collisions that
truncation causes by chance, before its whole sets are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import linking as L
from quern.llm import words as W
from quern.llm.shared import save

BUCKET_BITS, MANTISSA_BITS, BAND_ROWS = 7, 10, 4
BUCKETS = 1 << BUCKET_BITS
#: Standard deviations below the threshold at which an estimate still sends a pair on to verification.
SLACK = 5.0


def sketch(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Registers (n, BUCKETS) of the sets between consecutive offsets."""
    h = W.seeded(sets, 1)
    bucket = (h >> W.U(64 - BUCKET_BITS)).astype(np.int64)
    rest = h << W.U(BUCKET_BITS)
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    least = np.full(((len(off) - 1) * BUCKETS,), np.iinfo(np.uint64).max, W.U)
    np.minimum.at(least, owner * BUCKETS + bucket, rest)
    _, exponent = np.frexp(least.astype(np.float64))  # 2 ** (exponent - 1) <= value, up to rounding
    top = np.maximum(exponent - 1, 0)
    high = least >> np.minimum(top, 63).astype(W.U)
    top = np.where(high == 0, top - 1, top)  # rounded up to the next power
    zeros = np.minimum(63 - top, 62)
    left = least << (zeros + 1).clip(0, 63).astype(W.U)  # drops the leading one
    mantissa = left >> W.U(64 - MANTISSA_BITS)
    sig = (zeros.astype(W.U) << W.U(MANTISSA_BITS) | mantissa).astype(np.uint16)
    sig[least == np.iinfo(np.uint64).max] = L.EMPTY
    return sig.reshape(-1, BUCKETS)


_ZEROS = np.arange(40)
_MIDS = (_ZEROS[:, None] * 0 + 2.0 ** -(_ZEROS[:, None] + 1)) * (1 + (np.arange(8) + 0.5) / 8)


def chance_collisions(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Probability that a bucket's registers of two unrelated sets are equal: the least values' densities integrated over cells of one register value."""
    a, b = (np.maximum(x, 1) / BUCKETS for x in (na, nb))
    total = np.zeros(len(a))
    for z in range(40):
        cell = 2.0 ** -(z + 1 + MANTISSA_BITS)
        for x in _MIDS[z]:
            total += a * b * np.exp(-(a + b) * x) * cell * 2.0 ** -(z + 1) / 8
    return total


def estimate(sa: np.ndarray, na: np.ndarray, sb: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated Jaccard similarity, and the number of registers it rests on."""
    used = ((sa != L.EMPTY) | (sb != L.EMPTY)).sum(1)
    same = ((sa == sb) & (sa != L.EMPTY)).sum(1)
    both = ((sa != L.EMPTY) & (sb != L.EMPTY)).sum(1)
    p = chance_collisions(na, nb) * BUCKETS / np.maximum(both, 1)
    p = np.minimum(p, 0.5)
    return np.clip((same - p * both) / np.maximum(used - p * both, 1), 0, 1), used


def likely(percent: int):
    """A test that pairs at or above the similarity pass but for one in millions."""
    t = percent / 100

    def test(sa: np.ndarray, na: np.ndarray, sb: np.ndarray, nb: np.ndarray) -> np.ndarray:
        ok = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
        at = np.flatnonzero(ok)
        est, used = estimate(sa[at], na[at], sb[at], nb[at])
        ok[at] = est + SLACK * np.sqrt(t * (1 - t) / np.maximum(used, 1)) >= t
        return ok

    return test


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    raw, off = W.buffer(column)
    return W.distinct(*W.shingles(*W.word_hashes(raw, off, lower=True), k))


def signed(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, d (xxhash64 of the text, 0 if it is null), n_shingles, d1, d2 (a digest of the set) and sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, off = W.buffer(batch.column(2))
            for i, j in W.slices(off):
                values, soff = shingle_sets(batch.column(2).slice(i, j - i), k)
                digest = []
                for seed in (2, 3):
                    run = np.concatenate([np.zeros(1, W.U), np.cumsum(W.seeded(values, seed), dtype=W.U)])
                    digest.append(pa.array((run[soff[1:]] - run[soff[:-1]]).view(np.int64)))
                sig = sketch(values, soff)
                cols = [batch.column(c).slice(i, j - i) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(soff)), *digest, W.binaries(sig)], ["doc_id", "d", "n_shingles", "d1", "d2", "sig"])

    return _rows(docs).mapInArrow(run, "doc_id bigint, d bigint, n_shingles bigint, d1 bigint, d2 bigint, sig binary")


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("d"), text.alias("text"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable over links), kept (it is its own).

    Words are split at ASCII white space with A-Z lower-cased; a set is the distinct shingles of ``k`` words, or the
    whole sequence if there are fewer. Documents are linked at 100 * intersection >= percent * union. Empty sets are linked
    with nothing. Documents of one set, by its size and two digests of 64 bits, form a class, and only classes are compared. A null doc_id is linked with
    nothing, has a null component_id and is kept. Rows that share a doc_id are one document with all their sets: whatever is
    linked with one of them is linked with all. An empty table gives no rows.
    """
    rows = save(signed(docs, k), "signed")
    named = rows.where("n_shingles > 0 and doc_id is not null")
    by = ["n_shingles", "d1", "d2"]
    least = named.groupBy(*by).agg(F.min(F.struct("doc_id", "d")).alias("at"), F.first("sig").alias("sig"))
    classes = save(least.select(*by, "at.doc_id", "at.d", "sig").withColumn("id", F.monotonically_increasing_id()), "classes")
    items = classes.select("id", F.col("n_shingles").alias("n"), "sig")
    place = classes.select("id", "doc_id", "d")

    # Rows of one doc_id, if there are any: their classes belong together, and equal texts are read once.
    several = save(rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"), "several")
    texts, same = _rows(docs), None
    if not several.isEmpty():
        texts = texts.dropDuplicates(["doc_id", "d"])
        sets_of = named.join(several, "doc_id").select("doc_id", *by).distinct().join(classes.select(*by, "id"), by).select("doc_id", "id")
        same = save(sets_of.join(sets_of.groupBy("doc_id").agg(F.min("id").alias("first")), "doc_id").where("id != first").select(F.col("id").alias("a"), F.col("first").alias("b")), "same")

    def sets(column: pa.Array) -> list[np.ndarray]:
        values, off = shingle_sets(column, k)
        return [values[off[i] : off[i + 1]] for i in range(len(off) - 1)]

    def attach(asked: DataFrame) -> DataFrame:
        return asked.join(place.hint("shuffle_hash"), "id").join(texts.hint("merge"), ["doc_id", "d"])

    parts = L.link(items, BUCKETS, BAND_ROWS, percent, likely(percent), attach, sets, same)
    linked = parts.unionByName(parts.select(F.col("component").alias("node"), "component").distinct()).withColumnRenamed("node", "id")
    of_part = linked.join(place.select("id", "doc_id"), "id")
    first = of_part.groupBy("component").agg(F.min("doc_id").alias("_c"))
    found = linked.join(first, "component").select("id", "_c")
    of = classes.select(*by, "id", F.col("doc_id").alias("_own")).join(found, "id", "left").select(*by, F.coalesce("_c", "_own").alias("_c"))
    out = rows.drop("sig").join(of.hint("merge"), by, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_c", "doc_id"))
    if same is not None:  # an empty text beside others of its doc_id belongs to their component
        whole = save(out.select("doc_id", "n_shingles", component.alias("component_id")), "linked")
        least = whole.join(several, "doc_id").groupBy("doc_id").agg(F.min("component_id").alias("_least"))
        out = whole.join(least, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("_least", "component_id").alias("component_id"))
        component = F.col("component_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay: the one of least doc_id of each component, and all that are linked with nothing.

    Of rows that repeat one doc_id all stay or all go. Columns are as they were.
    """
    gone = near_duplicates(docs, k, percent).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    kept = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("_id"))
    kept = kept.join(gone.hint("merge"), kept["_id"] == gone["_gone"], "left_anti")
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
