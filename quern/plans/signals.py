"""Binary formats and signal features over data derived from the table embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quern.functions import audio as fn
from quern.operators import audio
from quern.operators.index import Settings, VectorIndex
from quern.plans.vectors import _BASE, index_of, table
from quern.sources import codecs, tables


def _content(spark, sf_dir):
    """One table file of each shard: partition lists of its tracks, and a record for each track."""
    lists = index_of(spark, sf_dir).reverse().groupBy("shard", "track_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("occurrence", "partition"))), lambda x: x["partition"]).alias("p"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for t, p in zip(pdf["track_id"], pdf["p"], strict=True):
            name = f"track-{t}".encode()
            rows += [(codecs.record_key("R", int(t)), codecs.pack_partitions([int(x) for x in p])), (codecs.record_key("M", int(t)), b"\x1a" + bytes([len(name)]) + name)]
        return pd.DataFrame({"path": [f"shard-{pdf['shard'].iloc[0]}"], "content": [codecs.write_table(sorted(rows), 256)]})

    return lists.groupBy("shard").applyInPandas(build, "path string, content binary")


def table_scan(spark, sf_dir):
    return tables.reverse(tables.scan_tables(_content(spark, sf_dir)))


def table_tracks(spark, sf_dir):
    return tables.tracks(tables.scan_tables(_content(spark, sf_dir))).select("path", F.col("id").alias("track"), "title")


def table_multi_get(spark, sf_dir):
    keys = spark.createDataFrame([(bytearray(codecs.record_key("M", i)),) for i in (0, 3, 4, 77)], "key binary")
    return tables.get_many(tables.scan_tables(_content(spark, sf_dir)), keys).select("path", F.hex("key").alias("key"), F.octet_length("value").alias("size"))


def wav_scan(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 30000).cast("int")).alias("samples"))

    def pack(batches):
        for b in batches:
            yield pd.DataFrame({"path": b["vec_id"].astype(str), "content": [codecs.write_wav(22_050, map(int, s)) for s in b["samples"]]})

    read = tables.wav_files(e.mapInPandas(pack, "path string, content binary"), 22_050)
    return read.select(F.col("path").cast("bigint").alias("vec_id"), "sample_rate", F.posexplode("samples").alias("i", "sample"))


def _captures(spark, n: int = 3):
    def make(batches):
        for b in batches:
            yield pd.DataFrame({"capture_id": b["id"], "sample_rate": 16_000, "samples": [codecs.deterministic_pcm(40_000 * (int(i) + 1), 0x12345678 + int(i)) for i in b["id"]]})

    return spark.range(n).repartition(n).mapInPandas(make, "capture_id bigint, sample_rate int, samples array<int>")


def resample_counts(spark, sf_dir):
    return audio.resample(_captures(spark)).select("capture_id", F.size("pcm").alias("n"), F.round(F.aggregate("pcm", F.lit(0.0), lambda s, x: s + x * x), 3).alias("energy"))


def resample_vectors(spark, sf_dir):
    """Every vector as 64 samples at twice the rate of the signal chain, resampled to 32."""
    e = table(spark, sf_dir, "embeddings")
    sample = lambda x: F.least(F.greatest(F.floor(x.cast("double") * 30000), F.lit(-32000)), F.lit(32000)).cast("int")
    out = audio.resample(e.select(F.col("vec_id").alias("capture_id"), F.lit(2 * fn.RATE).alias("sample_rate"), F.transform("embedding", sample).alias("samples")))
    return out.select(F.col("capture_id").alias("vec_id"), F.posexplode("pcm").alias("n", "x")).select("vec_id", "n", (F.round(F.col("x").cast("double"), 4) + 0.0).alias("x"))  # no negative zero


def frontend_windows(spark, sf_dir):
    rows = audio.fingerprint_windows(audio.resample(_captures(spark)))
    return rows.select("capture_id", "qi", F.size("spectrum").alias("values"), F.round(F.array_max("spectrum"), 2).alias("most"))


def music_scores(spark, sf_dir):
    return audio.gate(audio.music_scores(audio.resample(_captures(spark)), fn.Detector.generated()))


def recognize_pcm(spark, sf_dir):
    """Captures against an index of their own embeddings."""
    captures, embedder = _captures(spark, 2), fn.Embedder.generated()
    own = audio.embeddings(audio.resample(captures), embedder).select((F.col("capture_id") * 100 + F.col("qi")).alias("vec_id"), F.col("q").alias("embedding"), F.col("capture_id").cast("int").alias("label"))
    first = own.orderBy("vec_id").limit(4).toPandas()  # four rows at most
    x = np.array(first["embedding"].tolist())
    settings = Settings(subspaces=12, words=len(x), partitions=len(x), probes=len(x))
    book = x.reshape(len(x), 12, -1).transpose(1, 0, 2).copy()
    index = VectorIndex(x, book, None, None, settings)
    placed = index.assign(own.withColumnRenamed("label", "track_id").withColumn("track_id", F.col("track_id").cast("bigint")).withColumn("shard", F.lit(0)), "embedding")
    index.leaves = placed.select("vec_id", "shard", "partition", "track_id", (F.col("vec_id") % 100).cast("int").alias("occurrence"), F.lit(0).alias("ordinal"), "code")
    index.metadata = own.select(F.lit(0).alias("shard"), F.col("label").cast("bigint").alias("track_id")).distinct().withColumn("title", F.lit("own"))
    return audio.recognize_pcm(captures, index, fn.Detector.generated(), embedder, threshold=0.0).select("capture_id", "track_id", "offset")


QUERIES = {f.__name__: f for f in (table_scan, table_tracks, table_multi_get, wav_scan, resample_counts, resample_vectors, frontend_windows, music_scores, recognize_pcm)}
#: The half kernel at the distances that occur at twice the rate.
_WEIGHTS = ", ".join(f"({k}, {float(w)!r})" for k, w in enumerate(fn.kaiser_wing()[:: fn.PHASES // 2]))
ORACLES = {
    "resample_vectors": f"""WITH w(k, w) AS (VALUES {_WEIGHTS}), s AS (SELECT vec_id, i, least(greatest(floor(embedding[i + 1]::DOUBLE * 30000), -32000), 32000) / 32768.0 AS x FROM embeddings, range(64) AS r(i))
SELECT vec_id, n::INT AS n, round((0.5 * sum(w * x))::FLOAT::DOUBLE, 4) + 0.0 AS x FROM range(32) AS t(n), s JOIN w ON k = abs(i - 2 * n) GROUP BY vec_id, n""",
    "table_scan": _BASE + "SELECT 'shard-' || shard AS path, track_id, occurrence::INT AS occurrence, partition FROM leaves",
    "table_tracks": _BASE + "SELECT 'shard-' || shard AS path, track_id AS track, title FROM meta",
    "table_multi_get": _BASE + "SELECT 'shard-' || shard AS path, '4D' || printf('%02X', track_id::INT) || '0000' AS key, 2 + length(title)::INT AS size FROM meta WHERE track_id IN (0, 3, 4)",
    "wav_scan": "SELECT vec_id, 22050 AS sample_rate, i::INT AS i, floor(embedding[i + 1]::DOUBLE * 30000)::INT AS sample FROM embeddings, range(64) AS x(i)",
}
