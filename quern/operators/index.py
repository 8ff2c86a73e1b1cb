"""Inverted-file search with product quantisation, over single vectors and over time-aligned sequences.

Centroids and codebooks have a fixed size and are broadcast as arrays; vectors, inverted lists and hits are DataFrames.
Every query row carries its capture, so many captures are searched at once. Distances are rounded to 6 digits and scores
to 4 before they are ranked, so that order doesn't hang on the sum's order; ties go by shard, partition, track, ordinal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scalars import finite, score_finish, softplus, squared_l2
from quern.sources.saved import saved


@dataclass(frozen=True)
class Scoring:
    """Fixed values of the scorer."""

    mass_scale: float = 8.863962e-5
    distance_scale: float = 19.368963
    similarity_bias: float = -0.57549864
    distinct_scale: float = 1.4525973
    distinct_bias: float = 0.6349993
    exponent: float = 16.925064
    similarity_scale: float = 25.503857
    shape: float = -1.7260404
    offset: float = 0.7775212
    mass_per_byte: float = 0.77596563
    neighbours: int = 200


@dataclass(frozen=True)
class Settings:
    subspaces: int = 8
    words: int = 256
    partitions: int = 32
    probes: int = 4
    raw_hits: int = 1001
    shortlist: int = 40
    limit: int = 10
    threshold: float = 0.0
    scoring: Scoring = field(default_factory=Scoring)

    def __post_init__(self):
        if self.probes < 1 or self.probes > self.partitions:
            raise ValueError("probes must be between 1 and the number of partitions")
        if self.subspaces < 1 or self.words < 1 or self.limit < 0:
            raise ValueError("sizes must be positive")


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1)


def _append(rows: DataFrame, inputs: list[str], added: dict[str, str], make) -> DataFrame:
    """``rows`` with the columns ``added``, which ``make`` computes from the arrays of ``inputs`` batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([*b.columns, *make(*(_matrix(b.column(c), len(b)) for c in inputs))], [*b.schema.names, *added])

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), *(f"{n} {t}" for n, t in added.items())]))


class VectorIndex:
    """leaves: shard, partition, pos, track_id, occurrence, ordinal, code. metadata: shard, track_id and whatever describes a track."""

    def __init__(self, centroids: np.ndarray, codebook: np.ndarray, leaves: DataFrame, metadata: DataFrame, settings: Settings = Settings()):
        if codebook.shape[:2] != (settings.subspaces, settings.words):
            raise ValueError("the codebook's shape doesn't fit the settings")
        if centroids.shape != (settings.partitions, settings.subspaces * codebook.shape[2]):
            raise ValueError("the centroids' shape doesn't fit the settings")
        self.centroids, self.codebook, self.leaves, self.metadata, self.settings = centroids, codebook, leaves, metadata, settings

    @classmethod
    def from_embeddings(cls, vectors: DataFrame, settings: Settings = Settings()) -> VectorIndex:
        """Codewords are the parts of vectors with id below ``words``, centroids the vectors with id below ``partitions``; a label is a track, its parity a shard."""
        small = vectors.where(F.col("vec_id") < max(settings.words, settings.partitions)).select("vec_id", "embedding").orderBy("vec_id").toArrow()  # bounded by the settings
        x = _matrix(small.column("embedding").combine_chunks(), len(small))
        codebook = x[: settings.words].reshape(settings.words, settings.subspaces, -1).transpose(1, 0, 2).copy()
        index = cls(x[: settings.partitions], codebook, None, None, settings)
        index._vectors = vectors
        return index

    @cached_property
    def _placed(self) -> DataFrame:
        """Vectors with their partition, code, occurrence and ordinal; made once, when something first reads them."""
        order = Window.partitionBy("shard", "track_id").orderBy("vec_id")
        vectors, index = self._vectors, self
        placed = index.assign(vectors.select("vec_id", F.col("label").cast("bigint").alias("track_id"), F.pmod(F.col("label"), F.lit(2)).cast("int").alias("shard"), "embedding"), "embedding")
        rows = placed.withColumn("occurrence", F.row_number().over(order) - 1).drop("embedding")
        inside = Window.partitionBy("shard", "partition", "track_id").orderBy("occurrence")
        return saved(rows.withColumn("ordinal", F.row_number().over(inside) - 1).select("vec_id", "shard", "partition", "track_id", "occurrence", "ordinal", "code"), "leaves")

    @property
    def leaves(self) -> DataFrame:
        return self._placed if self._leaves is None else self._leaves

    @leaves.setter
    def leaves(self, rows: DataFrame) -> None:
        self._leaves = rows

    @property
    def metadata(self) -> DataFrame:
        if self._metadata is not None:
            return self._metadata
        rows = self.leaves
        return rows.groupBy("shard", "track_id").agg(F.count("*").alias("duration_seconds")).select("shard", "track_id", F.concat(F.lit("track-"), "track_id").alias("title"), F.concat(F.lit("artist-"), "shard").alias("artist"), F.col("duration_seconds").cast("double").alias("duration_seconds"))

    @metadata.setter
    def metadata(self, rows: DataFrame) -> None:
        self._metadata = rows

    def positions(self) -> DataFrame:
        """Leaves with their place in the inverted list of a partition."""
        return self.leaves.withColumn("pos", F.row_number().over(Window.partitionBy("shard", "partition").orderBy("track_id", "occurrence")) - 1)

    def reverse(self) -> DataFrame:
        """(shard, track_id, occurrence, partition, ordinal): the partitions that a track visits, in order."""
        return self.leaves.select("shard", "track_id", "occurrence", "partition", "ordinal")

    def assign(self, rows: DataFrame, vector: str) -> DataFrame:
        """Adds ``partition``, the nearest centroid, and ``code``, the nearest codeword of each subspace; ties to the lowest."""
        cents, book = self.centroids, self.codebook

        def make(x):
            part = np.concatenate([np.round(((a[:, None] - cents) ** 2).sum(2), 6).argmin(1) for a in np.array_split(x, max(1, len(x) // 256))])
            return pa.array(part.astype(np.int32)), pa.array(list(_codes(x, book).astype(np.int32)), pa.list_(pa.int32()))

        return _append(rows, [vector], {"partition": "int", "code": "array<int>"}, make)

    def nearest_partitions(self, queries: DataFrame, probes: int | None = None) -> DataFrame:
        """``queries`` (with a vector q) times their ``probes`` nearest centroids: partition, distance, rank."""
        cents, k = self.centroids, probes or self.settings.probes

        def make(x):
            d = np.round(np.stack([((a - cents) ** 2).sum(1) for a in x]), 6)
            best = np.argsort(d, axis=1, kind="stable")[:, :k]
            kind = pa.list_(pa.struct([("partition", pa.int32()), ("distance", pa.float64()), ("rank", pa.int32())]))
            return (pa.array([[{"partition": int(p), "distance": float(row[p]), "rank": r + 1} for r, p in enumerate(b)] for b, row in zip(best, d, strict=True)], kind),)

        found = _append(queries, ["q"], {"_near": "array<struct<partition:int,distance:double,rank:int>>"}, make)
        return found.withColumn("_n", F.explode("_near")).select(*queries.columns, "_n.*")

    def lookup(self, queries: DataFrame) -> DataFrame:
        """Adds ``lut``: for each subspace the squared distance of the query's part to every codeword."""
        book = self.codebook

        def make(x):
            return (pa.array([list(_tables(v, book)) for v in x], pa.list_(pa.list_(pa.float64()))),)

        return _append(queries, ["q"], {"lut": "array<array<double>>"}, make)

    def quantize(self, rows: DataFrame, vector: str) -> DataFrame:
        book = self.codebook
        return _append(rows, [vector], {"code": "array<int>"}, lambda x: (pa.array(list(_codes(x, book).astype(np.int32)), pa.list_(pa.int32())),))

    def reconstruct(self, rows: DataFrame, code: str = "code") -> DataFrame:
        """Adds ``vector``, the codewords of a code one after the other."""
        book = self.codebook
        return _append(rows, [code], {"vector": "array<double>"}, lambda c: (pa.array(list(_vectors(c, book)), pa.list_(pa.float64())),))

    def asymmetric_distance(self, rows: DataFrame, query: str = "q", code: str = "code") -> DataFrame:
        """Adds ``distance``: looked-up distances of a query to a code, summed over subspaces."""
        book = self.codebook
        return _append(rows, [query, code], {"distance": "double"}, lambda q, c: (pa.array(np.round(((q - _vectors(c, book)) ** 2).sum(1), 6)),))

    def scan(self, queries: DataFrame) -> DataFrame:
        """All rows of the inverted lists that each query probes, with their distance. queries: capture_id, qi, q."""
        probes = self.nearest_partitions(queries).drop("distance", "rank")
        return self.asymmetric_distance(probes.join(self.leaves, "partition")).drop("q", "code")

    # single vectors

    def search_candidates(self, queries: DataFrame) -> DataFrame:
        """Least distance of each track to each query."""
        return self.scan(queries).groupBy("capture_id", "qi", "shard", "track_id").agg(F.min("distance").alias("distance"))

    def search(self, queries: DataFrame, limit: int) -> DataFrame:
        """The nearest tracks of each query with their metadata, which is looked up after the limit: a track without any drops out."""
        rank = F.row_number().over(Window.partitionBy("capture_id", "qi").orderBy("distance", "shard", "track_id"))
        best = self.search_candidates(queries).withColumn("rank", rank).where(F.col("rank") <= limit)
        return best.join(self.metadata, ["shard", "track_id"])

    # sequences

    def background_mass(self) -> float:
        bytes_ = F.sum(F.ceil(F.col("n") / 4) * 5)
        got = self.leaves.groupBy("shard", "track_id").agg(F.count("*").alias("n")).agg(bytes_.alias("b")).first()["b"]
        return float(got or 0) * self.settings.scoring.mass_per_byte

    def raw_hits(self, queries: DataFrame) -> DataFrame:
        order = Window.partitionBy("capture_id", "qi").orderBy("distance", "shard", "partition", "track_id", "ordinal")
        return self.scan(queries).withColumn("r", F.row_number().over(order)).where(F.col("r") <= self.settings.raw_hits)

    def metrics(self, queries: DataFrame, raw: DataFrame, mass: float) -> DataFrame:
        """(capture_id, qi, metric, retained): how near a neighbour of the query must be to count."""
        s, book = self.settings.scoring, self.codebook
        least = _append(queries.select("capture_id", "qi", "q"), ["q"], {"least": "double"}, lambda x: (pa.array(np.array([sum(_tables(v, book).min(1)) for v in x])),)).drop("q")
        near = raw.where(F.col("r") <= s.neighbours + 1).groupBy("capture_id", "qi").agg(F.count("*").alias("retained"), F.max("distance").alias("far"))
        joined = least.join(near, ["capture_id", "qi"], "left")
        factor = F.pow(s.mass_scale * mass / F.col("retained"), F.lit(1 / s.exponent))
        reach = F.coalesce(F.col("least") + (F.col("far") - F.col("least")) * factor, F.col("least"))
        return joined.select("capture_id", "qi", (s.similarity_bias + s.similarity_scale * reach).alias("metric"), F.coalesce("retained", F.lit(0)).alias("retained"))

    def weights(self, queries: DataFrame) -> DataFrame:
        """(capture_id, qi, weight): 1 over 1 plus the likeness to each other embedding of the capture."""
        s = self.settings.scoring
        a, b = queries.select("capture_id", F.col("qi").alias("i"), F.col("q").alias("qa")), queries.select("capture_id", F.col("qi").alias("j"), F.col("q").alias("qb"))
        pair = a.join(b, "capture_id").where("i > j").withColumn("like", 1 / (F.exp(squared_l2(F.col("qa"), F.col("qb")) * s.distinct_scale - s.distinct_bias) + 1))
        both = pair.select("capture_id", F.explode(F.array("i", "j")).alias("qi"), "like").groupBy("capture_id", "qi").agg(F.sum("like").alias("like"))
        return queries.select("capture_id", "qi").join(both, ["capture_id", "qi"], "left").select("capture_id", "qi", (1 / (1 + F.coalesce("like", F.lit(0.0)))).alias("weight"))

    def biases(self, weights: DataFrame, mass: float) -> DataFrame:
        s = self.settings.scoring
        if not (np.isfinite(mass) and mass > 0):
            raise ValueError("the background mass must be finite and positive")
        shape = float(np.log1p(np.exp(s.shape)))
        w = F.col("w")
        norm = (w - 1) * shape + F.log(F.expm1(-shape * w) / F.expm1(F.lit(-shape)))
        return weights.groupBy("capture_id").agg(F.sum("weight").alias("w")).select("capture_id", (s.offset - F.lit(float(np.log(mass))) - norm).alias("bias"))

    def score(self, distances: DataFrame, keys: list[str], terms: DataFrame, biases: DataFrame) -> DataFrame:
        """distances: capture_id, keys, qi, distance. A query without a distance adds nothing."""
        u = F.sum(F.col("weight") * softplus(F.col("metric") - self.settings.scoring.distance_scale * F.col("distance")))
        summed = distances.join(terms, ["capture_id", "qi"]).groupBy("capture_id", *keys).agg(u.alias("u"))
        return summed.join(biases, "capture_id").select("capture_id", *keys, F.round(score_finish(F.col("u"), F.col("bias")), 4).alias("score"))

    def prepared(self, queries: DataFrame) -> dict:
        """What scoring needs, each made once: hits, the terms of each query, biases."""
        raw, mass = saved(self.raw_hits(queries), "hits"), self.background_mass()
        weights = saved(self.weights(queries), "weights")
        terms = self.metrics(queries, raw, mass).join(weights, ["capture_id", "qi"])
        return {"raw": raw, "terms": terms, "biases": self.biases(weights, mass), "weights": weights, "mass": mass}

    def shortlist(self, p: dict) -> DataFrame:
        """The best tracks of each capture by their least distance to each query, whenever they were near."""
        least = p["raw"].groupBy("capture_id", "qi", "shard", "track_id").agg(F.min("distance").alias("distance"))
        order = Window.partitionBy("capture_id").orderBy(F.desc("score"), "shard", "track_id")
        scored = self.score(least, ["shard", "track_id"], p["terms"], p["biases"])
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.settings.shortlist)

    def alignments(self, queries: DataFrame, p: dict) -> DataFrame:
        """Score of each offset (occurrence less query) that a hit of a shortlisted track suggests, from the codes at that offset."""
        short = self.shortlist(p).select("capture_id", "shard", "track_id")
        hits = p["raw"].join(short, ["capture_id", "shard", "track_id"], "left_semi")
        offsets = hits.select("capture_id", "shard", "track_id", (F.col("occurrence") - F.col("qi")).alias("offset")).distinct()
        dense = offsets.join(queries.select("capture_id", "qi", "q"), "capture_id").withColumn("occurrence", F.col("offset") + F.col("qi"))
        codes = self.leaves.select("shard", "track_id", "occurrence", "code")
        aligned = self.asymmetric_distance(dense.join(codes, ["shard", "track_id", "occurrence"])).drop("q", "code")
        return self.score(aligned, ["shard", "track_id", "offset"], p["terms"], p["biases"])

    def search_sequences(self, queries: DataFrame, limit: int | None = None) -> DataFrame:
        """Ranked tracks of each capture with their best offset; the smallest of equal ones."""
        best = self.alignments(queries, self.prepared(queries)).groupBy("capture_id", "shard", "track_id").agg(F.max(F.struct("score", -F.col("offset"))).alias("b"))
        best = best.select("capture_id", "shard", "track_id", "b.score", (-F.col("b.col2")).alias("offset"))
        order = Window.partitionBy("capture_id").orderBy(F.desc("score"), "shard", "track_id")
        top = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= (self.settings.limit if limit is None else limit))
        return top.join(self.metadata, ["shard", "track_id"])

    def recognize_embeddings(self, queries: DataFrame) -> DataFrame:
        """The first ranked track of each capture whose score is above the threshold."""
        found = self.search_sequences(queries).where(F.col("score") > self.settings.threshold)
        first = Window.partitionBy("capture_id").orderBy("rank")
        return found.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")

    def continuity(self, queries: DataFrame, previous: DataFrame) -> DataFrame:
        """Where a former match goes on: the code within two seconds of a predicted offset that is nearest to the first embedding.

        previous: capture_id, shard, track_id, predicted (array<double> of seconds; those not finite are left out). Score 2 less the distance.
        """
        at = previous.withColumn("p", F.explode("predicted")).where(finite(F.col("p"))).withColumn("occurrence", F.explode(F.sequence(F.round("p").cast("int") - 2, F.round("p").cast("int") + 2)))
        at = at.select("capture_id", "shard", "track_id", "occurrence").distinct()
        codes = self.leaves.select("shard", "track_id", "occurrence", "code")
        rows = at.join(codes, ["shard", "track_id", "occurrence"]).join(queries.where("qi = 0").select("capture_id", "q"), "capture_id")
        scored = self.asymmetric_distance(rows).select("capture_id", "shard", "track_id", F.col("occurrence").alias("offset"), F.round(2 - F.col("distance"), 6).alias("score"))
        order = Window.partitionBy("capture_id").orderBy(F.desc("score"), "offset")
        return scored.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def _tables(v: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((v.reshape(book.shape[0], 1, -1) - book) ** 2).sum(2)


def _codes(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    parts = x.reshape(len(x), book.shape[0], -1)
    return np.stack([np.concatenate([((p[:, None] - book[m]) ** 2).sum(2).argmin(1) for p in np.array_split(parts[:, m], max(1, len(x) // 256))]) for m in range(book.shape[0])], 1)


def _vectors(codes: np.ndarray, book: np.ndarray) -> np.ndarray:
    c = codes.astype(np.int64)
    if c.size and (c.min() < 0 or c.max() >= book.shape[1]):
        raise ValueError("a code lies outside the codebook")
    return book[np.arange(book.shape[0]), c].reshape(len(c), -1)
