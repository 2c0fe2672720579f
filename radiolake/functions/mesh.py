"""Scalar functions of the mesh model, as Column expressions visible to the optimizer."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

EARTH_KM = 6371
MERCATOR_M = 6378137
DAY_US = 86_400_000_000


def hex_id(number: Column) -> Column:
    """Eight hex digits, more for numbers beyond 32 bits; null for null."""
    return F.when(number.isNotNull(), F.format_string("%08x", number))


def int_id(text: Column) -> Column:
    """The number of a hex id, with or without its mark; null for anything else, and beyond 15 digits."""
    bare = strip_mark(F.trim(text))
    return F.when(bare.rlike("^[0-9A-Fa-f]{1,15}$"), F.conv(bare, 16, 10).cast("long"))


def strip_mark(text: Column) -> Column:
    return F.regexp_replace(text, "!", "")


def parse_id(text: Column) -> Column:
    """A hex id as it is; of other digits, the decimal number's id. Eight digits are taken as hex.

    Null for null, for a negative number and for one of more than 18 digits.
    """
    bare = strip_mark(F.trim(text))
    number = F.when(bare.rlike(r"^[+]?\d{1,18}$"), F.try_to_number(F.regexp_replace(bare, "[+]", ""), F.lit("999999999999999999")).cast("long"))
    return F.when(bare.rlike(r"^[+-]?\d+$") & (F.length(bare) != 8), hex_id(number)).otherwise(bare)


def parse_ids(listed: str | None) -> list[str]:
    """Ids of a comma-separated list, each decimal or hex, without blanks and repeats."""
    out: list[str] = []
    for raw in (x.strip().replace("!", "") for x in (listed or "").split(",")):
        one = f"{int(raw):08x}" if raw.isdecimal() and len(raw) not in (0, 8) else raw.lower()
        if one and one not in out:
            out.append(one)
    return out


def valid_id(text: Column) -> Column:
    return F.coalesce(F.length(strip_mark(text)) == 8, F.lit(False))


def known_id(text: Column) -> Column:
    """An id without its mark; null if it is not one of eight characters."""
    return F.when(valid_id(text), strip_mark(text))


def degrees_of(scaled: Column) -> Column:
    return scaled / 1e7


def has_position(lat_i: Column, lon_i: Column) -> Column:
    """Both coordinates known and neither zero."""
    return (F.coalesce(lat_i, F.lit(0)) != 0) & (F.coalesce(lon_i, F.lit(0)) != 0)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * F.asin(F.sqrt(a)) * EARTH_KM


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Rounded to 10 m; null if a coordinate is."""
    return F.round(haversine_km(lat1, lon1, lat2, lon2), 2)


def planar_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.round(F.sqrt(F.pow(lon2 - lon1, 2) + F.pow(lat2 - lat1, 2)) * 111.32, 2)


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * MERCATOR_M


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * MERCATOR_M


def seconds_within_day(micros: Column) -> Column:
    """Seconds of an interval beyond its whole days."""
    return F.floor(F.pmod(micros, F.lit(DAY_US)) / 1_000_000)


def days_of(micros: Column) -> Column:
    return F.floor(micros / DAY_US)


def uptime(seconds: Column) -> Column:
    """Days, hours and minutes in full, seconds within the minute; null for null."""
    whole = lambda n: F.floor(seconds / n)
    return F.when(seconds.isNotNull(), F.format_string("%dd %dh %dm %ds", whole(86400), whole(3600), whole(60), seconds % 60))


def local_time(epoch_s: Column, zone: str = "UTC", pattern: str = "yyyy-MM-dd HH:mm:ss Z") -> Column:
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(epoch_s), zone), pattern)


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def parse_iso(text: Column) -> Column:
    """An ISO time, with or without an offset, as a timestamp; null if it is none."""
    return text.try_cast("timestamp")


def with_unit(metric: Column, unit: str, decimals: int = 0) -> Column:
    """A number with its unit; a metric that is no number as it is. What is rounded to zero from below, and negative zero, keep their sign."""
    number = number_or_null(metric)
    rounded = F.round(number, decimals)  # of a negative number it may be zero without a sign
    sign = F.when((rounded == 0) & number.cast("string").startswith("-"), "-").otherwise("")
    return F.when(number.isNotNull(), F.concat(sign, F.format_string(f"%.{decimals}f", rounded + 0.0), F.lit(unit))).otherwise(metric.cast("string"))


#: Unit and decimals that each metric is shown with; ``*_ch1`` to ``*_ch3`` as their metric.
UNITS = {
    "air_util_tx": ("%", 2), "channel_utilization": ("%", 1), "battery_level": ("%", 2), "voltage": (" V", 2), "current": (" mA", 2), "barometric_pressure": (" hPa", 2),
    "relative_humidity": ("%", 2), "temperature": ("°C", 2), "gas_resistance": (" Ohm", 2), "distance": (" km", 2), "altitude": (" m", 0),
}


def shown(metrics: Column, name: str) -> Column:
    """A metric of a map as it is shown, with its unit; null where there is none."""
    unit, decimals = UNITS[re.sub("_ch[123]$", "", name)]
    return with_unit(metrics[name], unit, decimals)


def place_name(*parts: Column) -> Column:
    """The parts of an address that are there, from the nearest on, by commas; null if none is."""
    name = F.concat_ws(", ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])
    return F.nullif(name, F.lit(""))


def all_known(*metrics: Column) -> Column:
    """Whether none is null."""
    out = F.lit(True)
    for m in metrics:
        out &= m.isNotNull()
    return out


def first_known(*choices: Column) -> Column:
    """The first that is not null, of fields in order of precedence."""
    return F.coalesce(*choices)


def has_markers(text: Column, *markers: str) -> Column:
    """Whether a text contains every marker."""
    out = F.lit(True)
    for m in markers:
        out &= F.coalesce(text.contains(m), F.lit(False))
    return out


def utf8_or_null(data: Column) -> Column:
    """Bytes as text; null if they are not UTF-8."""
    return F.try_validate_utf8(data)


def link(base: str, *parts: Column) -> Column:
    return F.concat(F.lit(base), *parts)


def number_or_null(metric: Column) -> Column:
    return metric.try_cast("double")


def initials(name: Column) -> Column:
    return F.array_join(F.transform(F.split(name, " "), lambda w: F.substring(w, 1, 1)), "")


def little_endian64(number: Column) -> Column:
    pairs = F.regexp_extract_all(F.lpad(F.hex(number), 16, "0"), F.lit("(..)"), F.lit(1))
    return F.unhex(F.array_join(F.reverse(pairs), ""))


def asks_for_refresh(last: Column, now: Column, minutes: int = 60) -> Column:
    return last.isNull() | (last < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)))


def topic_matches(topic: Column, subscription: str) -> Column:
    """MQTT wildcards: ``+`` one level, a final ``#`` any number of levels."""
    parts = ["[^/]+" if p == "+" else "".join(c if c.isalnum() else "\\" + c for c in p) for p in subscription.split("/")]
    return topic.rlike("^" + ("/".join(parts[:-1]) + "(/.*)?$" if parts[-1] == "\\#" else "/".join(parts) + "$"))


def bridged(topic: Column, subscription: str, old_prefix: str, new_prefix: str) -> Column:
    """A topic that a bridge lets through, under its new prefix; null for others."""
    return F.when(topic_matches(topic, subscription) & topic.startswith(old_prefix), F.concat(F.lit(new_prefix), F.substr(topic, F.lit(len(old_prefix) + 1))))


def register(spark: SparkSession) -> None:
    """The same as SQL functions."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION mesh_hex(id BIGINT) RETURNS STRING RETURN CASE WHEN id IS NOT NULL THEN format_string('%08x', id) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION mesh_int(id STRING) RETURNS BIGINT RETURN CASE WHEN replace(id, '!', '') RLIKE '^[0-9A-Fa-f]{1,15}$' THEN CAST(conv(replace(id, '!', ''), 16, 10) AS BIGINT) END")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION haversine_km(a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE) RETURNS DOUBLE RETURN "
        f"2 * {EARTH_KM} * asin(sqrt(pow(sin(radians(c - a) / 2), 2) + cos(radians(a)) * cos(radians(c)) * pow(sin(radians(d - b) / 2), 2)))"
    )
