"""State that outlives a run: the active catalog, results and histories as JSON, and the history's table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from quern.functions.scalars import BUILD, COUNTRY, SHARD
from quern.operators.catalog import MAX_BYTES, MAX_PACKS

MAX_DOCUMENT = 1_048_576
PACKS = "array<struct<name:string,size:bigint>>"
ACTIVE = f"struct<build:string,country:string,packs:{PACKS},complete:boolean>"

#: Every column is filled; ids grow with insertion.
HISTORY = StructType(
    [
        StructField("id", LongType(), False),
        *(StructField(c, StringType(), False) for c in ("track", "artist", "track_id", "shard")),
        StructField("numeric_id", LongType(), False),
        StructField("offset_seconds", DoubleType(), False),
        StructField("score", DoubleType(), False),
        StructField("recognized_at_ms", LongType(), False),
    ]
)


def history_table(rows: DataFrame) -> DataFrame:
    """``rows`` with the columns and types of HISTORY, newest first within a partition; a null in any of them raises."""
    filled = lambda f: F.coalesce(F.col(f.name).cast(f.dataType), F.raise_error(F.lit(f"null in {f.name}")).cast(f.dataType)).alias(f.name)
    return rows.select(*(filled(f) for f in HISTORY)).sortWithinPartitions(F.desc("recognized_at_ms"), F.desc("id"))


def active_document() -> Column:
    """The JSON text of an active catalog from the columns build, country, packs and complete."""
    return F.to_json(F.struct("build", "country", F.col("packs").cast(PACKS).alias("packs"), "complete"))


def parse_active(document: Column) -> Column:
    """An active catalog as a struct ACTIVE; null for text that is missing, too long or malformed, or breaks a rule of its fields."""
    got = F.from_json(document, ACTIVE)
    packs = got["packs"]
    names = F.transform(packs, lambda p: p["name"])
    right = (
        F.octet_length(document).between(1, MAX_DOCUMENT)
        & got["build"].rlike(BUILD)
        & got["country"].rlike(COUNTRY)
        & (F.size(packs) <= MAX_PACKS)
        & F.forall(packs, lambda p: F.coalesce(p["name"].rlike(SHARD) & p["size"].between(1, MAX_BYTES), F.lit(False)))
        & (F.size(F.array_distinct(names)) == F.size(names))
    )
    whole = F.struct(got["build"].alias("build"), got["country"].alias("country"), packs.alias("packs"), F.coalesce(got["complete"], F.lit(False)).alias("complete"))
    return F.when(F.coalesce(right, F.lit(False)), whole)


def read_active(states: DataFrame, objects: DataFrame, key: str = "store") -> DataFrame:
    """``states`` (key, document) with ``active``: the parsed catalog, null unless every one of its packs is an object of its size.

    objects: key, name, size: the files that each store holds.
    """
    parsed = states.withColumn("active", parse_active(F.col("document")))
    packs = parsed.select(key, F.explode("active.packs").alias("p")).select(key, "p.name", "p.size")
    missing = packs.join(objects.select(key, "name", "size"), [key, "name", "size"], "left_anti").select(key).distinct().withColumn("_missing", F.lit(True))
    return parsed.join(missing, key, "left").withColumn("active", F.when(F.col("_missing").isNull(), F.col("active"))).drop("_missing")


def catalog_state(actives: DataFrame, key: str = "store") -> DataFrame:
    """What is shown of a store: build, country, shards, bytes, complete; zeros where no catalog is active."""
    a = F.col("active")
    total = F.aggregate(a["packs"], F.lit(0).cast("bigint"), lambda s, p: s + p["size"])
    return actives.select(key, a["build"].alias("build"), a["country"].alias("country"), F.coalesce(F.when(a.isNotNull(), F.size(a["packs"])), F.lit(0)).alias("shards"), F.coalesce(total, F.lit(0)).alias("bytes"), F.coalesce(a["complete"], F.lit(False)).alias("complete"))


def activate(wanted: DataFrame, objects: DataFrame, key: str = "store", strict: bool = True) -> DataFrame:
    """``wanted`` (key, build, country, packs, complete) as the documents to store: key, document.

    A pack that is no object of its size is an error: ``strict`` raises, else the document is null and ``error`` says so.
    """
    packs = wanted.select(key, F.explode("packs").alias("p")).select(key, "p.name", "p.size")
    missing = packs.join(objects.select(key, "name", "size"), [key, "name", "size"], "left_anti").groupBy(key).agg(F.count("*").alias("_n"))
    rows = wanted.join(missing, key, "left")
    error = F.when(F.col("_n").isNotNull(), F.lit("the catalog has a missing or truncated shard"))
    if strict:
        return rows.select(key, F.when(error.isNotNull(), F.raise_error(error).cast("string")).otherwise(active_document()).alias("document"))
    return rows.select(key, F.when(error.isNull(), active_document()).alias("document"), error.alias("error"))


def write_active(documents: DataFrame, path: str, document: str = "document") -> None:
    """One document for each row as a text file below ``path``, written beside what is there and then put in its place."""
    spark = documents.sparkSession
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    documents.select(document).write.mode("overwrite").text(f"{path}.partial")
    files.delete(make(path), True)
    files.rename(make(f"{path}.partial"), make(path))


def delete_downloaded(objects: DataFrame, key: str = "store") -> tuple[DataFrame, DataFrame]:
    """The objects that stay, which are none, and what went: key, files, bytes."""
    return objects.where(F.lit(False)), objects.groupBy(key).agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def ensure_objects(wanted: DataFrame, objects: DataFrame, key: str = "store") -> DataFrame:
    """(key, name, size, action) of wanted packs: ``reuse`` an object of the same size that is valid, else ``fetch``. objects: key, name, size, valid."""
    have = objects.select(key, "name", F.col("size").alias("_size"), "valid")
    rows = wanted.select(key, "name", "size").join(have, [key, "name"], "left")
    fits = F.coalesce((F.col("_size") == F.col("size")) & F.col("valid"), F.lit(False))
    return rows.select(key, "name", "size", F.when(fits, "reuse").otherwise("fetch").alias("action"))


MATCH = "struct<title:string,artist:string,trackId:string,numericId:bigint,shard:string,score:double,offset:bigint,duration:double>"
CONTINUITY = "struct<shard:string,numericId:bigint,score:double,offset:bigint>"
RESULT = f"musicScore double, continuity {CONTINUITY}, match {MATCH}"


def result_document(music: Column, continuity: Column, match: Column) -> Column:
    """The JSON text of a recognition; members without a value are null, and text is escaped."""
    return F.to_json(F.struct(music.cast("double").alias("musicScore"), continuity.cast(CONTINUITY).alias("continuity"), match.cast(MATCH).alias("match")), {"ignoreNullFields": "false"})


def parse_result(document: Column) -> Column:
    """The members of a result's JSON text; null for broken text, a number that isn't one is absent."""
    return F.from_json(document, f"struct<{RESULT.replace(' double', ':double').replace(' struct', ':struct')}>")


ENTRY = "struct<at_ms:bigint,matched:boolean,offsets_ms:array<bigint>,duration_ms:bigint>"


def encode_entries(entries: Column) -> Column:
    return F.to_json(entries.cast(f"array<{ENTRY}>"), {"ignoreNullFields": "false"})


def parse_entries(document: Column) -> Column:
    """A history of a JSON text; missing or broken text gives an empty one."""
    empty = F.array().cast(f"array<{ENTRY}>")
    return F.coalesce(F.from_json(document, f"array<{ENTRY}>"), empty)


def newest_offset(offsets_ms: Column) -> Column:
    """The greatest of a list of offsets; null for an empty or missing list."""
    return F.array_max(offsets_ms)


def can_arm(system_user: Column, foreground: Column, enabled: Column) -> Column:
    return F.coalesce(system_user, F.lit(False)) & F.coalesce(foreground, F.lit(False)) & F.coalesce(enabled, F.lit(False))


#: What a device announces once it is up.
BOOTED = ("android.intent.action.LOCKED_BOOT_COMPLETED", "android.intent.action.BOOT_COMPLETED")


def wants_immediate_sync(action: Column, complete: Column) -> Column:
    return ~complete & F.coalesce(action.isin(*BOOTED), F.lit(False))
