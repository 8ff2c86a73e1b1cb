"""Catalog packs: validated manifests, selection under a byte cap, and what a synchronisation has to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scalars import BUILD, COUNTRY, SHARD, countries

MAX_PACKS, MAX_BYTES, MAX_URLS = 10_000, 134_217_728, 8
MANIFEST = "struct<packs:array<struct<name:string,size:bigint,compressed_size:bigint,download_urls:array<string>,extra_type:string,extra_country_codes:string>>>"


def latest_build(listing: DataFrame, prefixes: str = "prefixes") -> DataFrame:
    """The greatest build id of pages of folder names."""
    names = listing.select(F.explode(prefixes).alias("p")).select(F.regexp_extract("p", "([^/]+)/?$", 1).alias("build"))
    return names.where(F.col("build").rlike(BUILD)).agg(F.max("build").alias("build"))


def manifest_errors(pack: Column) -> Column:
    """The first rule that a pack breaks, else null."""
    codes = countries(pack["extra_country_codes"])
    urls = pack["download_urls"]
    bad = lambda condition, says: F.when(~F.coalesce(condition, F.lit(False)), F.lit(says))
    return F.coalesce(
        bad(pack["name"].rlike(SHARD), "shard name"),
        bad(pack["size"].between(1, MAX_BYTES), "size"),
        bad(pack["compressed_size"].between(1, MAX_BYTES), "compressed size"),
        bad(F.size(urls).between(1, MAX_URLS), "number of addresses"),
        bad(F.forall(urls, lambda u: u.rlike("^https://")), "address"),
        bad(F.size(codes) > 0, "no country"),
        bad(F.forall(codes, lambda c: c.rlike(COUNTRY)), "country"),
    )


def parse_manifests(rows: DataFrame, build: str = "build", document: str = "document", strict: bool = True) -> DataFrame:
    """One row per shard pack of each manifest: build, pos, name, size, compressed_size, country_codes, download_urls.

    Packs of other types are left out before they are checked. ``strict`` raises at a broken rule or a repeated name; else
    an ``error`` column says what is wrong.
    """
    parsed = rows.select(F.col(build).alias("build"), F.from_json(F.col(document), MANIFEST).alias("m"))
    whole = F.coalesce(F.when(~F.coalesce(F.col("build").rlike(BUILD), F.lit(False)), F.lit("build name")), F.when(F.col("m.packs").isNull(), F.lit("no packs")), F.when(F.size("m.packs") > MAX_PACKS, F.lit("too many packs")))
    packs = parsed.withColumn("_whole", whole).select("build", "_whole", F.posexplode_outer("m.packs").alias("pos", "p"))
    packs = packs.where("_whole is not null or p.extra_type = 'shard'")
    again = F.when((F.count("*").over(Window.partitionBy("build", "p.name")) > 1) & F.col("p.name").isNotNull(), F.lit("repeated name"))
    packs = packs.withColumn("error", F.coalesce("_whole", manifest_errors(F.col("p")), again))
    out = packs.select("build", "pos", "p.name", "p.size", "p.compressed_size", countries(F.col("p.extra_country_codes")).alias("country_codes"), "p.download_urls", "error")
    if not strict:
        return out
    # A filter can't be pruned away as a column can, so an error is raised whichever columns are read.
    fine = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("invalid manifest: "), "error")).cast("boolean")).otherwise(F.lit(True))
    return out.where(fine).drop("error")


def select_packs(packs: DataFrame, country: str, cap: int | None) -> DataFrame:
    """The packs of a country in manifest order until one would pass the cap. Without a cap, one window is enough per build, as a manifest's size is bounded."""
    own = packs.where(F.array_contains("country_codes", country))
    if cap is not None:
        return pack_prefix(own, ["build"], "pos", "size", cap)
    return own.withColumn("total", F.sum("size").over(Window.partitionBy("build").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))


def pack_prefix(sizes: DataFrame, group: list[str], order: str, size: str, cap: int, fan: int = 4096) -> DataFrame:
    """The same rule for tables without a bound: the rows of each group, in order, whose running total stays within ``cap``.

    Sizes are summed by ranges of ``order`` first, at most ``fan`` for a group, so only the sums are ordered in one task and rows are ordered within their range.
    """
    span = sizes.agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    rows = sizes.crossJoin(F.broadcast(span)).withColumn("_b", F.floor((F.col(order) - F.col("_lo")) * fan / (F.col("_hi") - F.col("_lo") + 1))).drop("_lo", "_hi")
    before = F.sum("_t").over(Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    base = rows.groupBy(*group, "_b").agg(F.sum(size).alias("_t")).withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") <= cap).drop("_t")
    run = F.sum(size).over(Window.partitionBy(*group, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(base, [*group, "_b"]).withColumn("total", F.col("_before") + run).where(F.col("total") <= cap).drop("_b", "_before")


def catalog_diff(desired: DataFrame, active: DataFrame) -> DataFrame:
    """(name, size, action): keep what is active already, fetch what isn't, drop what is no longer wanted."""
    both = desired.select("name", "size").join(active.select("name", "size"), ["name", "size"], "left_semi").withColumn("action", F.lit("keep"))
    fetch = desired.select("name", "size").join(active.select("name", "size"), ["name", "size"], "left_anti").withColumn("action", F.lit("fetch"))
    stale = active.select("name", "size").join(desired.select("name", "size"), ["name", "size"], "left_anti").withColumn("action", F.lit("drop"))
    return both.unionByName(fetch).unionByName(stale)


def sync_plan(desired: list[tuple[str, int]], active: dict | None, build: str, country: str) -> dict:
    """What a synchronisation does with small lists of packs: nothing, go on from a prefix pack by pack, or swap once all are there.

    active: build, country, packs, complete.
    """
    if active and active["build"] == build and active["country"] == country and active["packs"] == desired:
        return {"mode": "none" if active["complete"] else "complete", "fetch": [], "activations": [] if active["complete"] else [desired]}
    prefix = bool(active) and active["build"] == build and active["country"] == country and desired[: len(active["packs"])] == active["packs"]
    have = set(active["packs"]) if active else set()
    if active is None or prefix:
        done = list(active["packs"]) if active else []
        steps = [desired[: n + 1] for n in range(len(done), len(desired))] or ([[]] if active is None else [])
        return {"mode": "resume", "fetch": [p for p in desired[len(done) :] if p not in have], "activations": steps}
    return {"mode": "swap", "fetch": [p for p in desired if p not in have], "activations": [desired]}


def parity(actual: DataFrame, expected: DataFrame, tolerance: float = 2.2888e-5) -> DataFrame:
    """Row by row agreement of recognitions: capture, agree (acceptance, track, shard and offset), score_agrees, score_delta."""
    e = expected.select("capture", *(F.col(c).alias(f"e_{c}") for c in ("accepted", "track", "shard", "offset", "score")))
    rows = actual.join(e, "capture", "left")
    same = F.col("accepted").eqNullSafe(F.col("e_accepted"))
    for c in ("track", "shard", "offset"):
        same = same & F.col(c).eqNullSafe(F.col(f"e_{c}"))
    delta = F.abs(F.col("score") - F.col("e_score"))
    return rows.select("capture", same.alias("agree"), F.coalesce(delta <= tolerance, F.lit(True)).alias("score_agrees"), delta.alias("score_delta"))


def parity_summary(compared: DataFrame) -> DataFrame:
    return compared.agg(F.count("*").alias("total"), F.count_if(~F.col("agree")).alias("disagreements"), F.count_if(~F.col("score_agrees")).alias("score_disagreements"))
