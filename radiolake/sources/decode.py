"""From broker messages to typed packets: topics, JSON envelopes, AES-CTR payloads, kinds."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from radiolake.functions.mesh import hex_id, little_endian64, strip_mark, topic_matches, utf8_or_null
from radiolake.sources import wire

ENVELOPE = (
    "id long, `from` long, `to` long, sender string, channel int, type string, timestamp long, rssi int, snr double, rx_time long, rx_rssi int, "
    "rx_snr double, hop_limit int, hop_start int, hops_away int, priority int, want_ack boolean, payload string"
)
POSITION = "latitude_i int, longitude_i int, altitude int, precision_bits int, time long, PDOP int, ground_speed int, sats_in_view int, ground_track int, timestamp long"
NODEINFO = "id string, hardware int, hw_model int, longname string, long_name string, shortname string, short_name string, role int"
TEXT = "text string"
TRACEROUTE = "route array<string>"
NEIGHBORINFO = "node_id long, last_sent_by_id long, neighbors_count int, node_broadcast_interval_secs int, neighbors array<struct<node_id:long,snr:double,last_rx_time:long,node_broadcast_interval_secs:int>>"
#: Application ports of the packet format and the kind that each carries.
PORTS = {1: "text", 3: "position", 4: "nodeinfo", 5: "routing", 67: "telemetry", 70: "traceroute", 71: "neighborinfo", 73: "mapreport"}
#: Kinds that are only logged.
LOGGED_ONLY = ("mapreport", "routing", "unknown")
PAYLOADS = {"position": POSITION, "nodeinfo": NODEINFO, "text": TEXT, "traceroute": TRACEROUTE, "neighborinfo": NEIGHBORINFO, "telemetry": "map<string,string>"}


def spread(rows: DataFrame, key: str) -> DataFrame:
    """A batch table of few partitions, dealt out by a key to all cores, as decoding costs far more than moving the rows; else as it is.

    A file's rows lie in as many tasks as it has row groups, fewer than its partitions, so these must be several times the cores to do.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(2 * cores, 16), key) if rows.rdd.getNumPartitions() < 4 * cores else rows


def subscribed(messages: DataFrame, topics: list[str]) -> DataFrame:
    """Messages of any of the topic filters."""
    wanted = F.lit(False)
    for t in topics:
        wanted |= topic_matches(F.col("topic"), t)
    return messages.filter(wanted)


#: What decides which node a packet touches, and how.
ROUTING = "`from` long, type string, payload string"


def parsed(rows: DataFrame, document: Column, fields: str) -> DataFrame:
    """``rows`` with the fields of a JSON column, of nulls where it is none.

    As the output of a generator, each document is parsed once; as a struct, the optimizer would parse it once a field that is used.
    """
    return rows.select("*", F.inline(F.array(F.from_json(document, fields))))


def routed(messages: DataFrame) -> DataFrame:
    """JSON messages ``(seq, ts_us, topic, body)`` as (seq, ts_us, from, type, payload), payloads undecoded."""
    rows = messages.filter(F.col("topic").contains("/2/json/")).select("seq", "ts_us", F.col("body").cast("string").alias("__body"))
    return parsed(rows, F.col("__body"), ROUTING).select("seq", "ts_us", hex_id(F.col("from")).alias("from"), F.coalesce("type", F.lit("unknown")).alias("type"), "payload")


def envelopes(messages: DataFrame) -> DataFrame:
    """JSON messages ``(seq, topic, body)`` with envelope columns and hex ids; bad JSON gives kind ``unknown``."""
    rows = messages.filter(F.col("topic").contains("/2/json/"))
    rows = parsed(rows, F.col("body").cast("string"), ENVELOPE).drop("body")
    return rows.withColumn("from", hex_id(F.col("from"))).withColumn("to", hex_id(F.col("to"))).withColumn("type", F.coalesce("type", F.lit("unknown")))


def payloads(packets: DataFrame, kind: str) -> DataFrame:
    """Packets of one kind with their payload as columns ``p``."""
    return packets.filter(F.col("type") == kind).withColumn("p", F.from_json("payload", PAYLOADS[kind])).drop("payload")


def kind_of_port(port: Column) -> Column:
    """The kind that a port carries; ``unknown`` for other ports and none."""
    kinds = F.create_map(*[F.lit(x) for pair in PORTS.items() for x in pair])
    return F.coalesce(kinds[port], F.lit("unknown"))


def typed(packets: DataFrame) -> DataFrame:
    """Packets with a column for each kind's payload, null for other kinds."""
    return packets.select("*", *[F.when(F.col("type") == k, F.from_json("payload", f)).alias(k) for k, f in PAYLOADS.items()]).drop("payload")


def metrics(device: Column, environment: Column) -> Column:
    """A telemetry packet's metrics: those of the surroundings if there are any, else the device's."""
    return F.coalesce(environment, device)


def text_payload(data: Column) -> Column:
    """Bytes of a text as text; null, so that no message is made, if they are not UTF-8."""
    return utf8_or_null(data)


def raw_payload(data: Column) -> Column:
    """Bytes of an unknown kind as text, ``{}`` if they are not."""
    return F.coalesce(utf8_or_null(data), F.lit("{}"))


def clean_log(packets: DataFrame) -> DataFrame:
    return packets.drop("decoded", "encrypted")


@F.pandas_udf(T.BinaryType())
def xor(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else (np.frombuffer(x, np.uint8) ^ np.frombuffer(y, np.uint8)[: len(x)]).tobytes() for x, y in zip(a, b, strict=True)])


def key_stream(length: Column, key: Column, packet_id: Column, sender: Column) -> Column:
    """Counter mode's key stream: the encrypted counter blocks, made by the built-in block cipher."""
    nonce = F.hex(F.concat(little_endian64(packet_id), F.substring(little_endian64(sender), 1, 4)))
    # data of whole blocks has one block of key stream more than it needs
    counters = F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(length / 16).cast("long")), lambda i: F.concat(nonce, F.lpad(F.hex(i), 8, "0")))
    blocks = F.unhex(F.array_join(counters, ""))  # each block is encrypted by itself, all by one call; the padding's is cut off
    return F.substring(F.aes_encrypt(blocks, key, F.lit("ECB"), F.lit("PKCS")), F.lit(1), F.length(blocks))


def decrypted(data: Column, key: Column, packet_id: Column, sender: Column) -> Column:
    """AES-CTR."""
    return xor(data, key_stream(F.length(data), key, packet_id, sender))


def decrypted_by_any(data: Column, keys: list[str], packet_id: Column, sender: Column, parses: Callable[[Column], Column]) -> Column:
    """The plaintext of the first of several base64 keys whose plaintext parses; null if none does."""
    plain = [decrypted(data, F.unbase64(F.lit(k)), packet_id, sender) for k in keys]
    return F.coalesce(*[F.when(parses(p), p) for p in plain])


def kinds_of(ports: pa.Array, bodies: pa.Array) -> pa.Array:
    return wire.payloads(ports, bodies, PORTS)


def opened(encrypted: pa.Array, streams: pa.Array) -> pa.Array:
    return wire.opened(encrypted, streams, PORTS)


def metric_map(values: Column, names: list[str]) -> Column:
    """A struct of numbers as a map of texts, without its nulls."""
    entries = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), values[n].cast("string").alias("value")) for n in names]), lambda e: e["value"].isNotNull())
    return F.when(values.isNotNull(), F.map_from_entries(entries))


def binary(messages: DataFrame, keys: list[str]) -> DataFrame:
    """Binary messages ``(seq, ts_us, topic, body)`` as packets with a column for each kind's payload, as ``typed`` has them.

    Packets that come encrypted are tried with each of the base64 ``keys``: the one whose plaintext can best be read counts (``wire.opened``). What can't be
    read (cut or foreign bytes, no key that fits, an empty payload of no port) is a packet of kind ``unknown``; envelopes that can't be have no sender either.
    """
    packet_columns, opened_data, payload_columns = F.arrow_udf(wire.packets, wire.PACKETS), F.arrow_udf(opened, wire.OPENED), F.arrow_udf(kinds_of, wire.PAYLOADS)
    rows = messages.filter(F.col("topic").contains("/2/e/") | F.col("topic").contains("/2/map/"))
    rows = rows.withColumn("m", packet_columns(F.coalesce(F.col("body").cast("binary"), F.lit(b"")))).select("seq", "ts_us", "topic", "m.*")
    secret = F.col("encrypted").isNotNull() & F.col("port").isNull() & F.col("id").isNotNull() & F.col("from").isNotNull()
    streams = F.array(*[key_stream(F.length("encrypted"), F.unbase64(F.lit(k)), F.col("id"), F.col("from")) for k in keys]) if keys else F.lit(None).cast("array<binary>")
    rows = rows.withColumn("o", opened_data(F.when(secret, F.col("encrypted")).otherwise(F.lit(b"")), F.when(secret, streams)))
    rows = rows.withColumn("d", payload_columns(F.coalesce("port", "o.port"), F.coalesce("data", "o.data", F.lit(b""))))
    kind = F.when(F.col("d.whole"), F.col("d.kind")).otherwise("unknown")
    info, near, hop, c = F.col("d.nodeinfo"), F.col("d.neighborinfo"), F.lit(None), F.col
    ints = lambda at, fields: F.when(at.isNotNull(), F.struct(*[at[f].cast(t).alias(f) for f, t in fields]))
    place = [tuple(f.split()) for f in POSITION.split(", ")]
    user = F.when(info.isNotNull(), F.struct(strip_mark(info["id"]).alias("id"), hop.cast("int").alias("hardware"), info["hw_model"].cast("int").alias("hw_model"), hop.cast("string").alias("longname"), info["long_name"].alias("long_name"), hop.cast("string").alias("shortname"), info["short_name"].alias("short_name"), info["role"].cast("int").alias("role")))
    neighbors = F.transform(near["neighbors"], lambda n: F.struct(n["node_id"].alias("node_id"), n["snr"].alias("snr"), n["last_rx_time"].alias("last_rx_time"), n["node_broadcast_interval_secs"].cast("int").alias("node_broadcast_interval_secs")))
    heard = F.when(near.isNotNull(), F.struct(near["node_id"].alias("node_id"), near["last_sent_by_id"].alias("last_sent_by_id"), F.size(neighbors).alias("neighbors_count"), near["node_broadcast_interval_secs"].cast("int").alias("node_broadcast_interval_secs"), neighbors.alias("neighbors")))
    telemetry = metrics(metric_map(c("d.device"), list(wire.DEVICE)), metric_map(c("d.environment"), list(wire.ENVIRONMENT)))
    return rows.select(
        "seq", "ts_us", "topic", "id", hex_id(c("from")).alias("from"), hex_id(c("to")).alias("to"), hop.cast("string").alias("sender"), c("channel").cast("int").alias("channel"), kind.alias("type"), c("rx_time").alias("timestamp"),
        c("rx_rssi").cast("int").alias("rssi"), c("rx_snr").alias("snr"), "rx_time", c("rx_rssi").cast("int").alias("rx_rssi"), "rx_snr", c("hop_limit").cast("int").alias("hop_limit"), c("hop_start").cast("int").alias("hop_start"),
        hop.cast("int").alias("hops_away"), c("priority").cast("int").alias("priority"), "want_ack", ints(c("d.position"), place).alias("position"), user.alias("nodeinfo"), F.when(c("d.text").isNotNull(), F.struct(c("d.text").alias("text"))).alias("text"),
        F.when(kind == "traceroute", F.struct(F.transform("d.route", hex_id).alias("route"))).alias("traceroute"), heard.alias("neighborinfo"), telemetry.alias("telemetry"), ints(c("d.mapreport"), place).alias("mapreport"), c("d.routing").alias("routing"),
    )
