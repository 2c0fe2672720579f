"""Folding the packet log into current state, in batch; the stream uses the same expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radiolake.functions.mesh import days_of, seconds_within_day

INACTIVE_S = 86_400
TELEMETRY = ("view", "click")


def fold(log: DataFrame) -> DataFrame:
    """Per sender the newest (seq, value) of every field; each kind of packet sets its own field."""

    def newest(field: str, *kinds: str) -> Column:
        return F.max(F.when(F.col("kind").isin(*kinds), F.struct("seq", F.col(field).alias("value"))))

    return log.groupBy("from_num").agg(
        F.max("ts_us").alias("last_us"), F.max("seq").alias("last_seq"), F.count("*").alias("packets"),
        newest("value", *TELEMETRY).alias("telemetry"), newest("k", "signup").alias("info"),
    )


def merge(one: DataFrame, two: DataFrame) -> DataFrame:
    """Folds of two parts of a log, in any order, as the fold of both."""
    both = one.alias("a").join(two.alias("b"), "from_num", "full")
    newest = [F.greatest(f"a.{c}", f"b.{c}").alias(c) for c in ("last_us", "last_seq", "telemetry", "info")]
    packets = F.coalesce("a.packets", F.lit(0)) + F.coalesce("b.packets", F.lit(0))
    return both.select("from_num", *newest, packets.alias("packets"))


def current(folded: DataFrame) -> DataFrame:
    """A fold's state as plain values."""
    return folded.withColumns({c: F.col(f"{c}.value") for c in ("telemetry", "info")})


def is_active(last_us: Column, now_us: Column, inactive_s: int = INACTIVE_S, within_day: bool = False) -> Column:
    """Heard from less than ``inactive_s`` ago; ``within_day`` looks at the age beyond whole days only."""
    age = now_us - last_us
    seconds = seconds_within_day(age) if within_day else F.floor(age / 1_000_000)
    return F.coalesce(seconds < inactive_s, F.lit(False))


def recent(last_us: Column, now_us: Column, days: int) -> Column:
    return days_of(now_us - last_us) <= max(days, 1)


def since_previous(log: DataFrame) -> DataFrame:
    order = Window.partitionBy("from_num").orderBy("ts_us", "seq")
    return log.withColumn("since_us", F.col("ts_us") - F.lag("ts_us").over(order))


def seeded(nodes: DataFrame, defaults: DataFrame) -> DataFrame:
    """Default rows for ids that are not there yet."""
    return nodes.unionByName(defaults.join(nodes, "id", "left_anti"))


def overlaid(nodes: DataFrame, overrides: DataFrame, columns: list[str]) -> DataFrame:
    """Replace ``columns`` in rows that have an override, even by null."""
    o = overrides.select(F.col("id").alias("__id"), *[F.col(c).alias(f"__{c}") for c in columns])
    out = nodes.join(o, nodes["id"] == F.col("__id"), "left")
    return out.select(*[F.when(F.col("__id").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in nodes.columns])


def enriched(nodes: DataFrame, lookup: DataFrame, columns: list[str]) -> DataFrame:
    """Overwrite ``columns`` by what a lookup knows."""
    found = lookup.select("id", *[F.col(c).alias(f"__{c}") for c in columns])
    out = nodes.join(found, "id", "left")
    return out.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in nodes.columns])


def needs_enrichment(shortname: Column, longname: Column) -> Column:
    return shortname.isNull() | longname.isNull() | (shortname == "UNK") | (longname == "Unknown")


def first_by_name(nodes: DataFrame, name: str, order: str) -> DataFrame:
    """The first node of each name."""
    w = Window.partitionBy(name).orderBy(order)
    return nodes.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The newest row of each key."""
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__rank = 1").drop("__rank")
