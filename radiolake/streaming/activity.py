"""Activity of nodes as a stream: when each appears, expires by silence, and returns.

A stateful operator keeps each node's newest time, whether it is active, and the packets that the watermark hasn't passed
yet. These are taken in order of time once it has, so packets that come late (within the watermark's delay), out of order or twice
lead to the same transitions as a replay in order. A timeout of event time is set to whatever is due next: the
earliest packet that waits, or the end of a node's time of activity; so a node expires without a packet of its own, as
soon as packets of others move the watermark past that point. Packets beyond the delay are dropped, as the watermark says.

State is a few numbers a node and what a delay's packets hold, for the nodes of one of ``SHARDS`` shards together: calls and state that are a node's own
would cost milliseconds each. It is checkpointed with the offsets, and a restarted query goes on from there.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from radiolake.operators.nodes import touches

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "id string, event string, at_us long, since_us long"
#: A list a node of each. ``waiting``: times, doubled, plus one where the packet makes its node known.
STATE = "ids array<string>, last_us array<long>, active array<boolean>, waiting array<array<long>>"
SHARDS = 256


def advanced(last: int | None, active: bool, passed: list[int], now: int, inactive_us: int) -> tuple[int | None, bool, list[tuple]]:
    """A node after the packets that the watermark ``now`` has passed, and its transitions."""
    out = []
    for w in passed:
        at = w // 2
        if active and at - last >= inactive_us:
            out.append(("expired", last + inactive_us, None))
            active = False
        if last is None and not w % 2:
            continue  # a text of a node that isn't known
        if not active:
            out.append(("appeared", at, None) if last is None else ("returned", at, at - last))
        last, active = at, True
    if active and last + inactive_us <= now:
        out.append(("expired", last + inactive_us, None))
        active = False
    return last, active, out


def activity(inactive_us: int):
    """What a batch makes of a shard's nodes: a function of its key, its new rows and its state."""

    def run(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        nodes = {i: (last, active, list(waiting)) for i, last, active, waiting in zip(*state.get, strict=True)} if state.exists else {}
        now, out, due = state.getCurrentWatermarkMs() * 1000, [], []
        if not state.hasTimedOut:
            for batch in rows:
                times = (batch["ts_us"].to_numpy() * 2 + batch["makes_known"].to_numpy()).astype("int64").tolist()
                for i, w in zip(batch["id"].tolist(), times, strict=True):
                    nodes.setdefault(i, (None, False, []))[2].append(w)
        for i, (last, active, waiting) in nodes.items():
            waiting.sort()
            passed = bisect_right(waiting, now * 2 + 1)
            last, active, found = advanced(last, active, waiting[:passed], now, inactive_us)
            out += [(i, *x) for x in found]
            nodes[i] = (last, active, waiting[passed:])
            if waiting[passed:]:
                due.append(waiting[passed] // 2)
            elif active:
                due.append(last + inactive_us)
        state.update((list(nodes), *([node[k] for node in nodes.values()] for k in range(3))))
        if due:
            state.setTimeoutTimestamp(max(1, -(-min(due) // 1000) - 1))  # it comes once the watermark is beyond it
        if out:
            yield pd.DataFrame(out, columns=["id", "event", "at_us", "since_us"]).astype({"since_us": "Int64"})

    return run


def heard(messages: DataFrame) -> DataFrame:
    """Messages, of a table or a stream, as (id, seq, ts, ts_us, makes_known)."""
    return touches(messages).select("id", "seq", F.timestamp_micros("ts_us").alias("ts"), "ts_us", (F.col("type") != "text").alias("makes_known"))


def transitions_stream(heard: DataFrame, out: str, checkpoint: str, inactive_s: int = 7200, late: str = "10 minutes") -> StreamingQuery:
    """Write the transitions of a stream ``heard`` as Parquet, each once."""
    spark = heard.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)  # on disk; a started query keeps it
    try:
        shard = F.pmod(F.xxhash64("id"), F.lit(SHARDS)).alias("shard")
        changes = heard.select("id", "ts", "ts_us", "makes_known", shard).withWatermark("ts", late).groupBy("shard").applyInPandasWithState(activity(inactive_s * 1_000_000), OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
        return changes.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def previous(rows: DataFrame, key: str, chunk_us: int = 6 * 3_600_000_000) -> DataFrame:
    """Rows with ``previous_us``: the time before, in the order of time, of the same key.

    A key's rows are looked at in chunks of time, so that a key that holds much of the log is many tasks' work; the last time of the chunk before
    comes from one row a key and chunk. Of equal times one is the other's previous.
    """
    rows = rows.withColumn("__chunk", F.floor(F.col("ts_us") / chunk_us))
    chunks = rows.groupBy(key, "__chunk").agg(F.max("ts_us").alias("__last"))
    before = chunks.select(key, "__chunk", F.lag("__last").over(Window.partitionBy(key).orderBy("__chunk")).alias("__before"))
    within = F.lag("ts_us").over(Window.partitionBy(key, "__chunk").orderBy("ts_us"))
    own = rows.withColumn("__within", within).join(before, [key, "__chunk"], "left")
    return own.withColumn("previous_us", F.coalesce("__within", "__before")).drop("__chunk", "__within", "__before")


def transitions(heard: DataFrame, now_us: Column, inactive_s: int = 7200) -> DataFrame:
    """The same of a table, up to ``now_us``."""
    silence = inactive_s * 1_000_000
    spans = heard.groupBy("id").agg(F.min(F.when(F.col("makes_known"), F.col("ts_us"))).alias("known_us"), F.max("ts_us").alias("last_us")).filter("known_us is not null")
    rows = previous(heard.join(spans, "id").filter("ts_us >= known_us").select("id", "ts_us"), "id")
    gap, last = F.col("ts_us") - F.col("previous_us"), F.col("previous_us")
    event = lambda name, at, since=None: F.struct(F.lit(name).alias("event"), at.alias("at_us"), (F.lit(None) if since is None else since).cast("long").alias("since_us"))
    found = F.when(last.isNull(), F.array(event("appeared", F.col("ts_us")))).when(gap >= silence, F.array(event("expired", last + silence), event("returned", F.col("ts_us"), gap)))
    ends = spans.filter(F.col("last_us") + silence <= now_us).select("id", F.inline(F.array(event("expired", F.col("last_us") + silence))))
    return rows.select("id", F.inline(found)).unionByName(ends)


def read_transitions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OUT).parquet(path)
