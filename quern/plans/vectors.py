"""Vector and sequence search over the table embeddings, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.scalars import squared_l2
from quern.operators.index import Settings, VectorIndex

SETTINGS = Settings(threshold=100.0)
LENGTH = 7  #: embeddings of a capture


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def index_of(spark: SparkSession, sf_dir: str) -> VectorIndex:
    return VectorIndex.from_embeddings(table(spark, sf_dir, "embeddings"), SETTINGS)


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """capture_id, qi, q: seven consecutive vectors of each label from its eleventh on, and a capture 100 of strays."""
    e = table(spark, sf_dir, "embeddings")
    own = e.withColumn("o", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).where(F.col("o").between(10, 9 + LENGTH))
    own = own.select(F.col("label").cast("bigint").alias("capture_id"), (F.col("o") - 10).alias("qi"), F.col("embedding").alias("q"))
    strays = e.where((F.col("vec_id") % 71 == 5) & (F.col("vec_id") < 71 * LENGTH)).select(F.lit(100).cast("bigint").alias("capture_id"), F.floor(F.col("vec_id") / 71).cast("int").alias("qi"), F.col("embedding").alias("q"))
    return own.unionByName(strays)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a capture of its own."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("capture_id"), F.lit(0).alias("qi"), F.col("embedding").alias("q"))


def single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries of the searches: every vector whose id is divisible by 50."""
    return vectors(spark, sf_dir).where("capture_id % 50 = 0")


def nearest_partitions(spark, sf_dir):
    found = index_of(spark, sf_dir).nearest_partitions(vectors(spark, sf_dir))
    return found.select(F.col("capture_id").alias("query_id"), "partition", "distance", "rank")


def quantize(spark, sf_dir):
    rows = index_of(spark, sf_dir).quantize(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding")
    return rows.select("vec_id", F.posexplode("code").alias("m", "codeword"))


def reconstruct(spark, sf_dir):
    index = index_of(spark, sf_dir)
    rows = index.reconstruct(index.quantize(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding"))
    return rows.select("vec_id", F.round(squared_l2(F.col("embedding"), F.col("vector")), 6).alias("error"))


def adc_lookup(spark, sf_dir):
    rows = index_of(spark, sf_dir).lookup(vectors(spark, sf_dir)).select(F.col("capture_id").alias("query_id"), F.posexplode("lut").alias("m", "row"))
    return rows.select("query_id", "m", F.round(F.array_min("row"), 6).alias("least"), F.round(F.array_max("row"), 6).alias("most"))


def inverted_list_scan(spark, sf_dir):
    return index_of(spark, sf_dir).scan(single(spark, sf_dir)).select(F.col("capture_id").alias("query_id"), "shard", "partition", "track_id", "ordinal", "distance")


def search_candidates(spark, sf_dir):
    return index_of(spark, sf_dir).search_candidates(single(spark, sf_dir)).select(F.col("capture_id").alias("query_id"), "shard", "track_id", "distance")


def search_topk(spark, sf_dir):
    return index_of(spark, sf_dir).search(single(spark, sf_dir), 3).select(F.col("capture_id").alias("query_id"), "rank", "shard", "track_id", "distance", "title", "artist")


def background_mass(spark, sf_dir):
    return spark.range(1).select(F.round(F.lit(index_of(spark, sf_dir).background_mass()), 4).alias("mass"))


def distinctiveness(spark, sf_dir):
    return index_of(spark, sf_dir).weights(captures(spark, sf_dir)).select("capture_id", "qi", F.round("weight", 6).alias("weight"))


def similarity_metric(spark, sf_dir):
    index, q = index_of(spark, sf_dir), captures(spark, sf_dir)
    return index.metrics(q, index.raw_hits(q), index.background_mass()).select("capture_id", "qi", F.round("metric", 4).alias("metric"), "retained")


def scorer_bias(spark, sf_dir):
    index = index_of(spark, sf_dir)
    return index.biases(index.weights(captures(spark, sf_dir)), index.background_mass()).select("capture_id", F.round("bias", 4).alias("bias"))


def shortlist(spark, sf_dir):
    index = index_of(spark, sf_dir)
    return index.shortlist(index.prepared(captures(spark, sf_dir))).select("capture_id", "shard", "track_id", "score", "rank")


def partition_ordinal(spark, sf_dir):
    return index_of(spark, sf_dir).positions().select("shard", "partition", "pos", "track_id", "occurrence", "ordinal")


def track_codes(spark, sf_dir):
    index = index_of(spark, sf_dir)
    keys = ["shard", "track_id", "partition", "ordinal"]
    rows = index.reverse().join(index.leaves.select(*keys, "code"), keys)
    return rows.select("shard", "track_id", "occurrence", "partition", F.array_join(F.col("code").cast("array<string>"), ",").alias("code"))


def alignments(spark, sf_dir):
    index, q = index_of(spark, sf_dir), captures(spark, sf_dir)
    return index.alignments(q, index.prepared(q))


def search_sequences(spark, sf_dir):
    return index_of(spark, sf_dir).search_sequences(captures(spark, sf_dir)).select("capture_id", "rank", "shard", "track_id", "score", "offset", "title", "artist", "duration_seconds")


def recognize_embeddings(spark, sf_dir):
    return index_of(spark, sf_dir).recognize_embeddings(captures(spark, sf_dir)).select("capture_id", "shard", "track_id", "score", "offset", "title", "artist")


def continuity(spark, sf_dir):
    q = captures(spark, sf_dir)
    before = q.where("capture_id < 100").select("capture_id").distinct().select("capture_id", F.pmod("capture_id", F.lit(2)).cast("int").alias("shard"), F.col("capture_id").alias("track_id"), F.array(F.lit(8.5), F.lit(11.0), F.lit(float("nan")), F.lit(-1.5)).alias("predicted"))
    return index_of(spark, sf_dir).continuity(q, before)


S = SETTINGS.scoring
DIST = "list_sum(list_transform(range(1, 65), lambda i: (({a})[i]::DOUBLE - ({b})[i]::DOUBLE) * (({a})[i]::DOUBLE - ({b})[i]::DOUBLE)))"
PART = "list_sum(list_transform(range(1, 9), lambda i: ({a}[m * 8 + i]::DOUBLE - {b}[m * 8 + i]::DOUBLE) * ({a}[m * 8 + i]::DOUBLE - {b}[m * 8 + i]::DOUBLE)))"
_BASE = f"""WITH sub AS (SELECT unnest(range(8)) AS m),
near AS (SELECT v.vec_id, c.vec_id AS c, round({DIST.format(a='v.embedding', b='c.embedding')}, 6) AS d FROM embeddings v, embeddings c WHERE c.vec_id < 32),
part AS (SELECT vec_id, c AS partition, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS r FROM near),
word AS (SELECT v.vec_id, m, c.vec_id AS k, {PART.format(a='v.embedding', b='c.embedding')} AS d FROM embeddings v, embeddings c, sub WHERE c.vec_id < 256),
codes AS (SELECT vec_id, m, min_by(k, struct_pack(d := d, k := k)) AS codeword, min(d) AS least, max(d) AS most FROM word GROUP BY vec_id, m),
leaf AS (SELECT v.vec_id, v.label::BIGINT AS track_id, (v.label % 2)::INT AS shard, p.partition::INT AS partition, row_number() OVER (PARTITION BY v.label ORDER BY v.vec_id) - 1 AS occurrence FROM embeddings v JOIN part p ON p.vec_id = v.vec_id AND p.r = 1),
leaves AS (SELECT *, row_number() OVER (PARTITION BY shard, partition, track_id ORDER BY occurrence) - 1 AS ordinal FROM leaf),
meta AS (SELECT shard, track_id, 'track-' || track_id AS title, 'artist-' || shard AS artist, count(*)::DOUBLE AS duration_seconds FROM leaf GROUP BY shard, track_id),
mass AS (SELECT sum(ceil(duration_seconds / 4) * 5) * {S.mass_per_byte} AS mass FROM meta),
single AS (SELECT vec_id AS capture_id, 0 AS qi, vec_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
captures AS (SELECT label::BIGINT AS capture_id, o - 10 AS qi, vec_id, embedding AS q FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS o FROM embeddings) WHERE o BETWEEN 10 AND 16
  UNION ALL SELECT 100, vec_id // 71, vec_id, embedding FROM embeddings WHERE vec_id % 71 = 5 AND vec_id < 497)
"""
#: Distance of a query vector to a code: the parts' distances to the codewords of the code.
_SCAN = """, recon AS (SELECT l.vec_id, c.m, l.shard, l.track_id, l.partition, l.occurrence, l.ordinal, c.codeword FROM leaves l JOIN codes c USING (vec_id)),
pairs AS (SELECT q.capture_id, q.qi, q.vec_id AS qv, l.vec_id, l.shard, l.partition, l.track_id, l.occurrence, l.ordinal FROM {queries} q JOIN part p ON p.vec_id = q.vec_id AND p.r <= 4 JOIN leaves l ON l.partition = p.partition),
hits AS (SELECT p.capture_id, p.qi, p.vec_id, p.shard, p.partition, p.track_id, p.occurrence, p.ordinal, round(sum(w.d), 6) AS distance FROM pairs p JOIN codes c ON c.vec_id = p.vec_id JOIN word w ON w.vec_id = p.qv AND w.m = c.m AND w.k = c.codeword GROUP BY ALL)
"""
_SOFT = "(greatest({x}, 0) + ln(1 + exp(-abs({x}))))"
_SHAPE = f"ln(1 + exp({S.shape}))"
_SCORER = f""", raw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, qi ORDER BY distance, shard, partition, track_id, ordinal) AS r FROM hits) WHERE r <= 1001),
floor AS (SELECT q.capture_id, q.qi, sum(c.least) AS least FROM captures q JOIN codes c USING (vec_id) GROUP BY ALL),
around AS (SELECT capture_id, qi, count(*) AS retained, max(distance) AS far FROM raw WHERE r <= 201 GROUP BY ALL),
metrics AS (SELECT f.capture_id, f.qi, {S.similarity_bias} + {S.similarity_scale} * coalesce(least + (far - least) * pow({S.mass_scale} * mass / retained, 1 / {S.exponent}), least) AS metric, coalesce(retained, 0) AS retained FROM floor f LEFT JOIN around USING (capture_id, qi), mass),
likes AS (SELECT a.capture_id, a.qi, sum(1 / (exp({DIST.format(a='a.q', b='b.q')} * {S.distinct_scale} - {S.distinct_bias}) + 1)) AS likeness FROM captures a JOIN captures b ON a.capture_id = b.capture_id AND a.qi <> b.qi GROUP BY ALL),
weights AS (SELECT capture_id, qi, 1 / (1 + coalesce(likeness, 0)) AS weight FROM captures LEFT JOIN likes USING (capture_id, qi)),
biases AS (SELECT capture_id, {S.offset} - ln(mass) - ((w - 1) * {_SHAPE} + ln((exp(-{_SHAPE} * w) - 1) / (exp(-{_SHAPE}) - 1))) AS bias FROM (SELECT capture_id, sum(weight) AS w FROM weights GROUP BY capture_id), mass),
terms AS (SELECT * FROM metrics JOIN weights USING (capture_id, qi)),
firsts AS (SELECT capture_id, qi, shard, track_id, min(distance) AS distance FROM raw GROUP BY ALL),
first_u AS (SELECT capture_id, shard, track_id, sum(weight * {_SOFT.format(x=f'(metric - {S.distance_scale} * distance)')}) AS u FROM firsts JOIN terms USING (capture_id, qi) GROUP BY ALL),
first_score AS (SELECT capture_id, shard, track_id, round(CASE WHEN u > 0 THEN ln(-(exp(-u) - 1)) + u + bias ELSE '-inf'::DOUBLE END, 4) AS score FROM first_u JOIN biases USING (capture_id)),
shortlist AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY score DESC, shard, track_id)::INT AS rank FROM first_score) WHERE rank <= 40),
offsets AS (SELECT DISTINCT capture_id, shard, track_id, occurrence - qi AS off FROM raw SEMI JOIN shortlist USING (capture_id, shard, track_id)),
dense AS (SELECT o.capture_id, o.shard, o.track_id, o.off, q.qi, q.vec_id AS qv, l.vec_id FROM offsets o JOIN captures q USING (capture_id) JOIN leaves l ON l.shard = o.shard AND l.track_id = o.track_id AND l.occurrence = o.off + q.qi),
aligned AS (SELECT d.capture_id, d.shard, d.track_id, d.off, d.qi, round(sum(w.d), 6) AS distance FROM dense d JOIN codes c ON c.vec_id = d.vec_id JOIN word w ON w.vec_id = d.qv AND w.m = c.m AND w.k = c.codeword GROUP BY ALL),
align_u AS (SELECT capture_id, shard, track_id, off, sum(weight * {_SOFT.format(x=f'(metric - {S.distance_scale} * distance)')}) AS u FROM aligned JOIN terms USING (capture_id, qi) GROUP BY ALL),
alignments AS (SELECT capture_id, shard, track_id, off AS "offset", round(CASE WHEN u > 0 THEN ln(-(exp(-u) - 1)) + u + bias ELSE '-inf'::DOUBLE END, 4) AS score FROM align_u JOIN biases USING (capture_id)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, shard, track_id ORDER BY score DESC, "offset") AS n FROM alignments) WHERE n = 1),
ranked AS (SELECT b.capture_id, row_number() OVER (PARTITION BY b.capture_id ORDER BY b.score DESC, b.shard, b.track_id)::INT AS rank, b.shard, b.track_id, b.score, b."offset", m.title, m.artist, m.duration_seconds FROM best b JOIN meta m USING (shard, track_id)),
sequences AS (SELECT * FROM ranked WHERE rank <= 10)
"""
_ONE = _BASE + _SCAN.format(queries="single")
_SEQ = _BASE + _SCAN.format(queries="captures") + _SCORER

QUERIES = {f.__name__: f for f in (nearest_partitions, quantize, reconstruct, adc_lookup, inverted_list_scan, search_candidates, search_topk, background_mass, distinctiveness, similarity_metric, scorer_bias, shortlist, partition_ordinal, track_codes, alignments, search_sequences, recognize_embeddings, continuity)}
ORACLES = {
    "nearest_partitions": _BASE + "SELECT vec_id AS query_id, partition::INT AS partition, d AS distance, r::INT AS rank FROM part WHERE r <= 4",
    "quantize": _BASE + "SELECT vec_id, m::INT AS m, codeword::INT AS codeword FROM codes",
    "reconstruct": _BASE + "SELECT vec_id, round(sum(least), 6) AS error FROM codes GROUP BY vec_id",
    "adc_lookup": _BASE + "SELECT vec_id AS query_id, m::INT AS m, round(least, 6) AS least, round(most, 6) AS most FROM codes",
    "inverted_list_scan": _ONE + "SELECT capture_id AS query_id, shard, partition, track_id, ordinal::INT AS ordinal, distance FROM hits",
    "search_candidates": _ONE + "SELECT capture_id AS query_id, shard, track_id, min(distance) AS distance FROM hits GROUP BY ALL",
    "search_topk": _ONE + "SELECT query_id, rank, shard, track_id, distance, title, artist FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, shard, track_id)::INT AS rank FROM (SELECT capture_id AS query_id, shard, track_id, min(distance) AS distance FROM hits GROUP BY ALL)) JOIN meta USING (shard, track_id) WHERE rank <= 3",
    "background_mass": _BASE + "SELECT round(mass, 4) AS mass FROM mass",
    "distinctiveness": _SEQ + "SELECT capture_id, qi::INT AS qi, round(weight, 6) AS weight FROM weights",
    "similarity_metric": _SEQ + "SELECT capture_id, qi::INT AS qi, round(metric, 4) AS metric, retained FROM metrics",
    "scorer_bias": _SEQ + "SELECT capture_id, round(bias, 4) AS bias FROM biases",
    "shortlist": _SEQ + "SELECT capture_id, shard, track_id, score, rank FROM shortlist",
    "partition_ordinal": _BASE + "SELECT shard, partition, (row_number() OVER (PARTITION BY shard, partition ORDER BY track_id, occurrence) - 1)::INT AS pos, track_id, occurrence::INT AS occurrence, ordinal::INT AS ordinal FROM leaves",
    "track_codes": _BASE + "SELECT shard, track_id, occurrence::INT AS occurrence, partition, string_agg(codeword::INT::VARCHAR, ',' ORDER BY m) AS code FROM leaves JOIN codes USING (vec_id) GROUP BY ALL",
    "alignments": _SEQ + 'SELECT capture_id, shard, track_id, "offset"::INT AS "offset", score FROM alignments',
    "search_sequences": _SEQ + 'SELECT capture_id, rank, shard, track_id, score, "offset"::INT AS "offset", title, artist, duration_seconds FROM sequences',
    "recognize_embeddings": _SEQ + 'SELECT capture_id, shard, track_id, score, "offset"::INT AS "offset", title, artist FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY rank) AS n FROM sequences WHERE score > 100) WHERE n = 1',
    "continuity": _BASE + """, spots AS (SELECT DISTINCT q.vec_id AS qv, capture_id, (p + unnest([-2, -1, 0, 1, 2]))::INT AS occurrence FROM (SELECT *, unnest([9, 11, -2]) AS p FROM captures WHERE qi = 0 AND capture_id < 100) q),
scored AS (SELECT a.capture_id, l.shard, l.track_id, l.occurrence, round(2 - round(sum(w.d), 6), 6) AS score FROM spots a JOIN leaves l ON l.track_id = a.capture_id AND l.occurrence = a.occurrence JOIN codes c ON c.vec_id = l.vec_id JOIN word w ON w.vec_id = a.qv AND w.m = c.m AND w.k = c.codeword GROUP BY ALL)
SELECT capture_id, shard, track_id, occurrence::INT AS "offset", score FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY score DESC, occurrence) AS r FROM scored) WHERE r = 1""",
}
