"""Column functions of the engine, all of them expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEG_INF = float("-inf")


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def score_finish(u: Column, bias: Column) -> Column:
    """ln(-expm1(-u)) + u + bias; minus infinity at u = 0, where ln gives null."""
    return F.when(u > 0, F.log(-F.expm1(-u)) + u + bias).otherwise(F.lit(NEG_INF))


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(F.greatest(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), F.lit(1e-12)))
    return F.transform(v, lambda x: x.cast("double") / norm)


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def round_half_up(x: Column, grid: int) -> Column:
    """To the nearest multiple of ``grid``, halves upwards, also below zero."""
    return (F.floor(x / F.lit(float(grid)) + 0.5) * grid).cast("bigint")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def elu(x: Column) -> Column:
    return F.when(x > 0, x).otherwise(F.expm1(x))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def within(a: Column, b: Column, tolerance: float) -> Column:
    """abs(a - b) <= tolerance; true where either is missing."""
    return F.coalesce(F.abs(a - b) <= tolerance, F.lit(True))


def record_key(family: str, id: Column) -> Column:
    """Family byte and a 24-bit little-endian id, as binary."""
    ok = F.when((id >= 0) & (id <= 0xFFFFFF), id).otherwise(F.raise_error(F.lit("id beyond 24 bits")).cast("bigint"))
    byte = lambda shift: F.lpad(F.hex(F.shiftright(ok, shift).bitwiseAND(255)), 2, "0")
    return F.unhex(F.concat(F.lit(f"{ord(family):02X}"), byte(0), byte(8), byte(16)))


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unpack_partitions(payload: Column) -> Column:
    """Partition numbers, four in five bytes: low bytes first, then their upper bits; 1023 pads the end, others are below 1000."""

    def unpacked(digits: Column) -> Column:
        byte = lambda g, i: F.conv(F.substring(digits, g * 10 + i * 2 + 1, F.lit(2)), 16, 10).cast("int")
        four = lambda g: let(byte(g, F.lit(4)), lambda u: F.array(*(byte(g, F.lit(i)) + F.shiftright(u, i * 2).bitwiseAND(3) * 256 for i in range(4))))
        groups = F.floor(F.length(digits) / 10).cast("int")
        return F.when(groups > 0, F.flatten(F.transform(F.sequence(F.lit(0), groups - 1), four))).otherwise(F.array().cast("array<int>"))

    def trimmed(numbers: Column) -> Column:
        return F.slice(numbers, 1, F.aggregate(F.transform(numbers, lambda x, n: F.when(x != 1023, n + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x)))

    def checked(kept: Column) -> Column:
        bad = (F.octet_length(payload) % 5 != 0) | F.exists(kept, lambda x: x >= 1000)
        return F.when(bad, F.raise_error(F.lit("malformed partition list")).cast("array<int>")).otherwise(kept)

    return let(let(let(F.hex(payload), unpacked), trimmed), checked)


BUILD = "^[0-9]{8}-[0-9]{6}$"
SHARD = "^[A-Z]{2}[0-9a-f]{32}$"
COUNTRY = "^[a-z]{2}$"


def base_url(url: Column) -> Column:
    """Trimmed https address without a final slash, query or fragment; null if it isn't one."""
    clean = F.regexp_replace(F.trim(url), "/+$", "")
    ok = F.lower(F.coalesce(F.try_parse_url(clean, F.lit("PROTOCOL")), F.lit(""))).eqNullSafe("https") & (F.coalesce(F.try_parse_url(clean, F.lit("HOST")), F.lit("")) != "") & F.try_parse_url(clean, F.lit("QUERY")).isNull() & ~clean.contains("#")
    return F.when(ok, clean)


def countries(list_: Column) -> Column:
    """Comma list to distinct lower-case trimmed codes."""
    return F.array_distinct(F.filter(F.transform(F.split(list_, ","), lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def display_text(title: Column, artist: Column) -> Column:
    return F.when(F.trim(artist) == "", title).otherwise(F.concat(title, F.lit(" • "), artist))


def cap_bytes(mib: Column) -> Column:
    """MiB to bytes; nothing or less means without limit (null)."""
    return F.when(mib > 0, mib * F.lit(1048576).cast("bigint"))


def minutes_ago(then: Column, now: Column) -> Column:
    minutes = F.floor(F.greatest(now - then, F.lit(0)) / 60000)
    return F.when(minutes < 1, F.lit("now")).when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min"))).otherwise(F.date_format(F.timestamp_millis(then), "yyyy-MM-dd HH:mm"))
