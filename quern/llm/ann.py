"""Approximate nearest neighbours by additive quantisation.

A unit vector is written as a sum of one full-dimensional codeword from each of M codebooks. Codebooks start from
residuals and are refitted together by least squares; encoding is a beam search over the books. A query scores a row by
adding M looked-up dot products and dividing by the row's stored norm; the best rows are scored again exactly.

Codebooks are fitted on a bounded sample, but every row is encoded and scored: there are no lists that a probe could miss.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.shared import drop, save


@dataclass(frozen=True)
class Settings:
    books: int = 32
    words: int = 64
    beam: int = 2
    sample: int = 8192  #: vectors that codebooks are fitted on, at most
    shortlist: int = 384  #: rows per query that are scored exactly
    query_block: int = 1024
    row_block: int = 1 << 16


def train(x: np.ndarray, s: Settings, seed: int = 7) -> np.ndarray:
    """Codebooks (books, words, dimensions) for unit vectors; fewer vectors than words repeat."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    books = np.zeros((s.books, s.words, x.shape[1]), np.float32)
    rest = x.copy()
    for m in range(s.books):
        c = rest[rng.choice(len(rest), s.words, replace=len(rest) < s.words)].copy()
        for _ in range(6):
            near = (rest @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
            n = np.bincount(near, minlength=s.words)
            total = np.zeros_like(c)
            np.add.at(total, near, rest)
            full = n > 0
            c[full] = total[full] / n[full, None]
        near = (rest @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
        rest -= c[near]
        books[m] = c
    codes = encode(x, books, s.beam)
    flat = s.books * s.words  # refit all books at once, held towards where they are
    gram, right = np.eye(flat) * 1.0, books.reshape(flat, -1).astype(float) * 1.0
    at = codes.astype(np.int64) + np.arange(s.books) * s.words
    for m in range(s.books):
        np.add.at(right, at[:, m], x)
        for j in range(s.books):
            np.add.at(gram, (at[:, m], at[:, j]), 1.0)
    return np.linalg.solve(gram, right).reshape(books.shape).astype(np.float32)


def encode(x: np.ndarray, books: np.ndarray, beam: int) -> np.ndarray:
    """Codes (n, books) of unit vectors, each by a beam search over the books in order."""
    out = np.zeros((len(x), len(books)), np.uint8 if books.shape[1] <= 256 else np.uint16)
    for a in range(0, len(x), 1024):
        part = x[a : a + 1024].astype(np.float32)
        n = len(part)
        rest = part[:, None, :]  # n, beams, dimensions
        error = (part * part).sum(1)[:, None]
        path = np.zeros((n, 1, 0), np.int64)
        for c in books:
            cost = error[:, :, None] - 2 * (rest.reshape(-1, x.shape[1]) @ c.T).reshape(n, -1, len(c)) + (c * c).sum(1)
            cost = cost.reshape(n, -1)
            k = min(beam, cost.shape[1])
            best = np.argpartition(cost, k - 1, axis=1)[:, :k]
            error = np.take_along_axis(cost, best, 1)
            of, word = best // len(c), best % len(c)
            rows = np.arange(n)[:, None]
            rest = rest[rows, of] - c[word]
            path = np.concatenate([path[rows, of], word[:, :, None]], 2)
        out[a : a + 1024] = path[np.arange(n), error.argmin(1)]
    return out


def scan(queries: np.ndarray, codes: np.ndarray, norms: np.ndarray, books: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores (queries, at most top) of the best rows by lookup tables. norms: of the sums the codes stand for."""
    tables = np.einsum("mkd,qd->mkq", books, queries.astype(np.float32), optimize=True)
    best_at = np.zeros((len(queries), 0), np.int64)
    best = np.zeros((len(queries), 0), np.float32)
    for a in range(0, len(codes), 4096):
        part = codes[a : a + 4096]
        score = tables[0][part[:, 0]]
        for m in range(1, len(books)):
            score += tables[m][part[:, m]]
        score = (score / norms[a : a + 4096, None]).T
        k = min(top, score.shape[1])
        near = np.argpartition(-score, k - 1, axis=1)[:, :k]
        best = np.concatenate([best, np.take_along_axis(score, near, 1)], 1)
        best_at = np.concatenate([best_at, near + a], 1)
        if best.shape[1] > top:
            keep = np.argpartition(-best, top - 1, axis=1)[:, :top]
            best, best_at = np.take_along_axis(best, keep, 1), np.take_along_axis(best_at, keep, 1)
    return best_at, best


def usable(rows: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, v) of rows that take part: id and vector not null, of the commonest length, all components finite, not all zero."""
    v = F.col(vector).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(F.col(id).isNotNull() & F.col(vector).isNotNull() & F.coalesce(good, F.lit(False))).select(F.col(id).cast("long").alias("id"), v.alias("v"))
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (size["d"] if size else 0))


def _blob(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def search(rows: DataFrame, queries: Column, id: str, vector: str, k: int = 5, s: Settings = Settings()) -> DataFrame:
    """The ``k`` rows nearest to each query row by cosine: query_id, rank (from 1), vec_id, score (exact, on the vectors as given).

    ``queries`` says which rows are queries; a row is no neighbour of itself, and rows that share an id count as one.
    Nearest first, ties to the smaller id. Vectors that take no part neither ask nor answer; with fewer than ``k`` others, all
    are returned. Equal vectors are searched once, by the least k + 1 of their ids, so a common vector costs no more than a rare one.
    """
    spark = rows.sparkSession
    good = usable(rows, id, vector)
    place = Window.partitionBy("v").orderBy("id")
    ids = save(good.distinct().withColumn("r", F.row_number().over(place)).where(F.col("r") <= k + 1), "vectors")
    cls = Window.partitionBy("v")
    near = save(ids.withColumn("cls", F.min("id").over(cls)), "vector-classes")
    one = near.where("r = 1").select("cls", "v")
    asked = good.withColumnRenamed("id", id).where(queries).select(F.col(id).alias("query_id"), "v").distinct()
    asked = save(asked.join(one, "v").select("query_id", "cls"), "asked")

    total = one.count()
    part = F.pmod(F.xxhash64("cls"), F.lit(1 << 20)) < min(1 << 20, int((1 << 20) * s.sample * 0.95 / max(1, total)) + 1)
    sample = np.array([r["v"] for r in (one if total <= s.sample else one.where(part)).select("v").limit(s.sample).collect()])
    if not len(sample):
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim = sample.shape[1]
    unit = lambda x: x / np.sqrt((x * x).sum(1, keepdims=True))
    scaled = lambda x: unit(x / np.abs(x).max(1, keepdims=True))  # noqa: E731  lengths beyond the range of squares
    books = train(scaled(sample), s)
    shared = spark.sparkContext.broadcast(books)  # books * words * dim floats
    asked_of = lambda p, c: np.array(p.column(c).flatten().to_numpy(zero_copy_only=False)).reshape(len(p), dim)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0

        def flush():
            ids, codes, norms = (np.concatenate(z) for z in zip(*held, strict=True))
            return pa.RecordBatch.from_pydict({"ids": [_blob(ids)], "codes": [_blob(codes)], "norms": [_blob(norms)]})

        for b in batches:
            if not len(b):
                continue
            codes = encode(scaled(asked_of(b, 1)), shared.value, s.beam)
            sums = sum(shared.value[m][codes[:, m]] for m in range(s.books))
            norms = np.maximum(np.sqrt((sums * sums).sum(1)), 1e-6).astype(np.float32)
            held.append((b.column(0).to_numpy(), codes, norms))
            count += len(b)
            if count >= s.row_block:
                yield flush()
                held, count = [], 0
        if held:
            yield flush()

    blocks = save(one.mapInArrow(encoded, "ids binary, codes binary, norms binary"), "codes")

    wanted = one.join(asked.select("cls").distinct(), "cls")
    n_blocks = max(1, -(-wanted.count() // s.query_block))
    query_rows = wanted.withColumn("qb", F.pmod(F.xxhash64("cls"), F.lit(n_blocks)).cast("int"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        for b in batches:
            if not len(b):
                continue
            qb, vec = b.column(0).to_numpy(), scaled(asked_of(b, 2)).astype(np.float32)
            for q in np.unique(qb).tolist():
                by.setdefault(q, []).append((b.column(1).to_numpy()[qb == q], vec[qb == q]))
        for q, xs in by.items():
            ids, vec = (np.concatenate(z) for z in zip(*xs, strict=True))
            for a in range(0, len(ids), s.query_block):
                yield pa.RecordBatch.from_pydict({"qb": pa.array([q], pa.int32()), "qids": [_blob(ids[a : a + s.query_block])], "qvec": [_blob(vec[a : a + s.query_block])]})

    query_blocks = query_rows.select("qb", "cls", "v").repartition(n_blocks, "qb").mapInArrow(packed, "qb int, qids binary, qvec binary")
    cells = blocks.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).join(query_blocks, "qb")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.uint8 if s.words <= 256 else np.uint16
        for b in batches:
            for r in b.to_pylist():
                ids, qids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["qids"], np.int64)
                codes = np.frombuffer(r["codes"], kind).reshape(len(ids), -1)
                vec, norms = np.frombuffer(r["qvec"], np.float32).reshape(len(qids), dim), np.frombuffer(r["norms"], np.float32)
                for a in range(0, len(qids), 256):
                    at, score = scan(vec[a : a + 256], codes, norms, shared.value, s.shortlist)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids[a : a + 256], at.shape[1])), pa.array(ids[at.ravel()]), pa.array(score.ravel().astype(np.float64))], ["q", "c", "near"])

    best = Window.partitionBy("q").orderBy(F.desc("near"), "c")
    short = cells.select("ids", "codes", "norms", "qids", "qvec").mapInArrow(scored, "q bigint, c bigint, near double").withColumn("r", F.row_number().over(best)).where(F.col("r") <= s.shortlist)
    pairs = short.select("q", "c").join(one.select(F.col("cls").alias("q"), F.col("v").alias("qv")), "q").join(one.select(F.col("cls").alias("c"), F.col("v").alias("cv")), "c")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x, y = asked_of(b, 2), asked_of(b, 3)
                x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
                score = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score)], ["q", "cls", "score"])

    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    answers = pairs.select("q", "c", "qv", "cv").mapInArrow(exact, "q bigint, cls bigint, score double").join(near.select("cls", F.col("id").alias("vec_id")), "cls")
    answers = answers.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).select("q", "vec_id", "score")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = asked.withColumnRenamed("cls", "q").join(answers, "q").where("vec_id != query_id").withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    drop(ids)
    return out.select("query_id", "rank", "vec_id", "score")


def neighbour_digest(embeddings: DataFrame) -> DataFrame:
    """Query op8: rows whose vec_id is divisible by 50 against all rows of embeddings."""
    return search(embeddings, F.col("vec_id") % 50 == 0, "vec_id", "embedding")
