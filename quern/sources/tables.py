"""DataFrames over binary files. A file is one row of ``binaryFile``, so files are decoded apart and read from any store that Spark knows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources import codecs


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def _decoded(rows: DataFrame, make: Callable[[dict], Iterator[tuple]], schema: str, strict: bool) -> DataFrame:
    """Rows that ``make`` yields for each row, with ``error`` in place of what can't be read; ``strict`` lets the first error end the job."""
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                out: list[tuple] = []
                try:
                    for x in make(row):
                        out.append((*x, None))
                        if len(out) == 10_000:
                            yield pd.DataFrame(out, columns=[*names, "error"])
                            out = []
                except codecs.FormatError as e:
                    if strict:
                        raise
                    out.append((*[None] * len(names), f"{row.get('path')}: {e}"))
                if out:
                    yield pd.DataFrame(out, columns=[*names, "error"], dtype="object")

    got = rows.mapInPandas(run, schema + ", error string")
    return got.drop("error") if strict else got


def scan_tables(content: DataFrame, strict: bool = True) -> DataFrame:
    """(path, key, value) of every entry of the tables in ``content`` (path, content), in key order within a file."""

    def make(row):
        for k, v in codecs.Table(bytes(row["content"])).entries():
            yield row["path"], k, v

    return _decoded(content, make, "path string, key binary, value binary", strict)


def validate_tables(content: DataFrame) -> DataFrame:
    """(path, entries, error): decodes every block of every table."""
    rows = scan_tables(content, strict=False)
    return rows.groupBy(F.coalesce("path", F.substring_index("error", ": ", 1)).alias("path")).agg(F.count("key").alias("entries"), F.max("error").alias("error"))


def table_offsets(content: DataFrame, keys: list[bytes]) -> DataFrame:
    """(path, key, offset): where each table's first block lies that may hold the key or a later one. Only the index of a table is decoded."""

    def make(row):
        t = codecs.Table(bytes(row["content"]))
        for k in keys:
            yield row["path"], k, t.approximate_offset(k)

    return _decoded(content, make, "path string, key binary, offset bigint", True)


def background_mass(content: DataFrame, per_byte: float = 0.77596563) -> DataFrame:
    """(path, mass): bytes of a table's reverse lists, from where the families R and S begin, times what a byte weighs."""
    at = lambda name: F.max(F.when(F.col("key") == F.lit(bytearray(name)), F.col("offset")))
    size = F.greatest(at(b"S") - at(b"R"), F.lit(0))
    return table_offsets(content, [b"R", b"S"]).groupBy("path").agg((size * per_byte).alias("mass"))


def lookup(content: DataFrame, keys: list[bytes], strict: bool = True) -> DataFrame:
    """(path, key, value) of a list of keys in every table; missing ones are absent. Each table's index says which of its blocks are decoded, each once."""

    def make(row):
        for k, v in codecs.Table(bytes(row["content"])).get_many(keys).items():
            yield row["path"], k, v

    return _decoded(content, make, "path string, key binary, value binary", strict)


def matcher_configs(content: DataFrame, subspaces: int = 12, words: int = 256, width: int = 8, strict: bool = True) -> DataFrame:
    """Configurations of matchers: path, partitions, probes, threshold, neighbours, scorer (a map), codebook, centroids."""

    def make(row):
        m = codecs.matcher(bytes(row["content"]), subspaces, words, width)
        scorer = dict(m["scorer"])
        yield row["path"], m["partitions"], m["probes"], m["threshold"], scorer.pop("neighbours"), scorer, m["codebook"], m["centroids"]

    return _decoded(content, make, "path string, partitions bigint, probes bigint, threshold double, neighbours bigint, scorer map<string,double>, codebook array<array<array<float>>>, centroids array<array<float>>", strict)


def get(entries: DataFrame, key: bytes) -> DataFrame:
    return entries.where(F.col("key") == F.lit(bytearray(key)))


def get_many(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """Entries of the keys in ``keys``; missing keys are absent. Spark broadcasts the smaller side only if it is small enough."""
    return entries.join(keys.select("key").distinct(), "key")


def family(entries: DataFrame, name: str) -> DataFrame:
    """Records of a family with their numeric id."""
    byte = lambda i: F.conv(F.hex(F.substring("key", i, 1)), 16, 10).cast("bigint")
    return entries.where(F.substring("key", 1, 1) == F.lit(bytearray(name.encode()))).withColumn("id", byte(2) + byte(3) * 256 + byte(4) * 65536)


TRACK = "path string, id bigint, track_id string, catalog_id string, title string, artist string, knowledge_graph_id string, album string, duration_seconds double, release_year bigint"


def tracks(entries: DataFrame, strict: bool = True) -> DataFrame:
    names = [x.split(" ")[0] for x in TRACK.split(", ")][2:]

    def make(row):
        t = codecs.track(bytes(row["value"]))
        yield (row["path"], row["id"], *(t[n] for n in names))

    return _decoded(family(entries, "M"), make, TRACK, strict)


def leaves(entries: DataFrame, code: codecs.PrefixCode, width: int = 12, strict: bool = True) -> DataFrame:
    """(path, partition, pos, track_id, code): inverted lists, a row per hit."""

    def make(row):
        for n, (i, c) in enumerate(zip(*codecs.leaf(bytes(row["value"]), code, width), strict=True)):
            yield row["path"], row["id"], n, i, list(c)

    return _decoded(family(entries, "T"), make, "path string, partition bigint, pos int, track_id bigint, code array<int>", strict)


def reverse(entries: DataFrame) -> DataFrame:
    """(path, track_id, occurrence, partition), by built-in bit operations."""
    from quern.functions.scalars import unpack_partitions

    return family(entries, "R").select("path", F.col("id").alias("track_id"), F.posexplode(unpack_partitions(F.col("value"))).alias("occurrence", "partition"))


def wav_files(content: DataFrame, rate: int | None = None, strict: bool = True) -> DataFrame:
    def make(row):
        found, samples = codecs.read_wav(bytes(row["content"]), rate)
        yield row["path"], found, samples

    return _decoded(content, make, "path string, sample_rate int, samples array<int>", strict)


def metadata_files(spark: SparkSession, path: str, pattern: str = "*.meta") -> DataFrame:
    """Files of key=value lines: path and a map."""
    rows = spark.read.format("text").option("wholetext", "true").option("pathGlobFilter", pattern).load(path)
    return rows.select(F.input_file_name().alias("path"), F.str_to_map(F.regexp_replace("value", r"\s+$", ""), F.lit("\n"), F.lit("=")).alias("entries"))


def write_tables(pairs: DataFrame, key: str, value: str, file: str, path: str) -> DataFrame:
    """Sink: one table per value of ``file`` (whose pairs fit a task, as a shard's do), returned as (file, content) and written as Parquet to ``path``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(map(bytes, pdf[key]), map(bytes, pdf[value]), strict=True))
        return pd.DataFrame({"file": [str(pdf[file].iloc[0])], "content": [codecs.write_table(rows)]})

    made = pairs.groupBy(file).applyInPandas(run, "file string, content binary")
    made.write.mode("overwrite").parquet(path)
    return pairs.sparkSession.read.parquet(path)


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=schema, emptyValue="", nullValue="")


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, sep="\t", header=True)


def write_metadata(rows: DataFrame, entries: str, path: str) -> None:
    """Sink of :func:`metadata_files`: a file of key=value lines for each row, keys in order, from a map column."""
    pairs = F.array_sort(F.map_entries(entries))
    text = F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), "\n")
    rows.select(text.alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
