"""Captures to embeddings: batches of arrays pass through NumPy in Arrow, gated before the costly network runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import audio as A
from quern.sources.saved import saved

THRESHOLD = 0.2


def _per_capture(rows: DataFrame, make: Callable[[dict], Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that ``make`` yields for each capture, a batch for each."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for values in zip(*(batch[c] for c in batch.columns), strict=True):
                out = list(make(dict(zip(batch.columns, values, strict=True))))
                if out:
                    yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, schema)


def resample(captures: DataFrame) -> DataFrame:
    """captures: capture_id, sample_rate, samples. Floats at 11,025 Hz as ``pcm``."""
    return _per_capture(captures.select("capture_id", "sample_rate", "samples"), lambda r: iter([(r["capture_id"], A.resample(r["samples"], int(r["sample_rate"])).tolist())]), "capture_id bigint, pcm array<float>")


def fingerprint_windows(pcm: DataFrame) -> DataFrame:
    """Spectra of the two-second windows: capture_id, qi, spectrum."""

    def make(r):
        for i, w in enumerate(A.windows(np.asarray(r["pcm"], A.F32), A.FINGERPRINT_WINDOW, A.FINGERPRINT_HOP)):
            yield r["capture_id"], i, A.fingerprint_input(w).ravel().tolist()

    return _per_capture(pcm, make, "capture_id bigint, qi int, spectrum array<float>")


def music_windows(pcm: DataFrame) -> DataFrame:
    def make(r):
        for i, w in enumerate(A.windows(np.asarray(r["pcm"], A.F32), A.MUSIC_WINDOW, A.MUSIC_HOP)):
            yield r["capture_id"], i, A.music_input(w).ravel().tolist()

    return _per_capture(pcm, make, "capture_id bigint, wi int, spectrum array<float>")


def music_scores(pcm: DataFrame, detector: A.Detector) -> DataFrame:
    """Probability of music in each five-second window: capture_id, wi, score. Windows, spectra and the network are one pass, so that no spectrum leaves it."""
    net = pcm.sparkSession.sparkContext.broadcast(detector)  # fixed size

    def make(r):
        for i, w in enumerate(A.windows(np.asarray(r["pcm"], A.F32), A.MUSIC_WINDOW, A.MUSIC_HOP)):
            yield r["capture_id"], i, net.value.infer(A.music_input(w))

    return _per_capture(pcm, make, "capture_id bigint, wi int, score double")


def gate(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Captures with any window above the threshold, and the score of their first window. A capture too short for a window has none."""
    return scores.groupBy("capture_id").agg(F.bool_or(F.col("score") > threshold).alias("passes"), F.min_by("score", "wi").alias("music_score"))


def embeddings(pcm: DataFrame, embedder: A.Embedder) -> DataFrame:
    """Unit vectors of the two-second windows, in one pass: capture_id, qi, q."""
    net = pcm.sparkSession.sparkContext.broadcast(embedder)  # fixed size

    def make(r):
        for i, w in enumerate(A.windows(np.asarray(r["pcm"], A.F32), A.FINGERPRINT_WINDOW, A.FINGERPRINT_HOP)):
            yield r["capture_id"], i, net.value.infer(A.fingerprint_input(w)).tolist()

    return _per_capture(pcm, make, "capture_id bigint, qi int, q array<float>")


def search_pcm(captures: DataFrame, index, embedder: A.Embedder) -> DataFrame:
    """The ranked tracks of each capture, without a gate before or a threshold behind: what :meth:`VectorIndex.search_sequences` gives."""
    return index.search_sequences(saved(embeddings(resample(captures), embedder), "embeddings"))


def recognize_pcm(captures: DataFrame, index, detector: A.Detector, embedder: A.Embedder, threshold: float = THRESHOLD) -> DataFrame:
    """The whole chain: resample, gate, embed what passes, search, accept. capture_id, music_score and the match, null without one."""
    pcm = saved(resample(captures), "pcm")
    gated = saved(gate(music_scores(pcm, detector), threshold), "gated")
    q = saved(embeddings(pcm.join(gated.where("passes"), "capture_id", "left_semi"), embedder), "embeddings")
    found = index.recognize_embeddings(q)
    return gated.join(found, "capture_id", "left")
