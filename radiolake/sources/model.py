"""The mesh model laid over the driver's tables: nodes, event log, chat, neighbour edges, routes."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from radiolake.functions.mesh import hex_id
from radiolake.sources import decode, wire

#: Role codes in order, with the abbreviation shown in lists.
ROLES = (
    (0, "Client", "C"), (1, "Client Mute", "CM"), (2, "Router", "R"), (3, "Router Client", "RC"), (4, "Repeater", "RE"), (5, "Tracker", "T"),
    (6, "Sensor", "S"), (7, "TAK", "A"), (8, "Client Hidden", "CH"), (9, "Lost and Found", "LF"), (10, "TAK Tracker", "AT"),
)
#: Hardware codes 0 to 65 without 24, and 255, with their names.
HARDWARE = (
    (0, "UNSET"), (1, "TLORA_V2"), (2, "TLORA_V1"), (3, "TLORA_V2_1_1P6"), (4, "TBEAM"), (5, "HELTEC_V2_0"), (6, "TBEAM_V0P7"), (7, "T_ECHO"), (8, "TLORA_V1_1P3"), (9, "RAK4631"),
    (10, "HELTEC_V2_1"), (11, "HELTEC_V1"), (12, "LILYGO_TBEAM_S3_CORE"), (13, "RAK11200"), (14, "NANO_G1"), (15, "TLORA_V2_1_1P8"), (16, "TLORA_T3_S3"), (17, "NANO_G1_EXPLORER"), (18, "NANO_G2_ULTRA"), (19, "LORA_TYPE"),
    (20, "WIPHONE"), (21, "WIO_WM1110"), (22, "RAK2560"), (23, "HELTEC_HRU_3601"), (25, "STATION_G1"), (26, "RAK11310"), (27, "SENSELORA_RP2040"), (28, "SENSELORA_S3"), (29, "CANARYONE"), (30, "RP2040_LORA"),
    (31, "STATION_G2"), (32, "LORA_RELAY_V1"), (33, "NRF52840DK"), (34, "PPR"), (35, "GENIEBLOCKS"), (36, "NRF52_UNKNOWN"), (37, "PORTDUINO"), (38, "ANDROID_SIM"), (39, "DIY_V1"), (40, "NRF52840_PCA10059"),
    (41, "DR_DEV"), (42, "M5STACK"), (43, "HELTEC_V3"), (44, "HELTEC_WSL_V3"), (45, "BETAFPV_2400_TX"), (46, "BETAFPV_900_NANO_TX"), (47, "RPI_PICO"), (48, "HELTEC_WIRELESS_TRACKER"), (49, "HELTEC_WIRELESS_PAPER"), (50, "T_DECK"),
    (51, "T_WATCH_S3"), (52, "PICOMPUTER_S3"), (53, "HELTEC_HT62"), (54, "EBYTE_ESP32_S3"), (55, "ESP32_S3_PICO"), (56, "CHATTER_2"), (57, "HELTEC_WIRELESS_PAPER_V1_0"), (58, "HELTEC_WIRELESS_TRACKER_V1_0"), (59, "UNPHONE"), (60, "TD_LORAC"),
    (61, "CDEBYTE_EORA_S3"), (62, "TWC_MESH_V4"), (63, "NRF52_PROMICRO_DIY"), (64, "RADIOMASTER_900_BANDIT_NANO"), (65, "HELTEC_CAPSULE_SENSOR_V3"), (255, "PRIVATE_HW"),
)
#: Codes of the hardware that there is a photo of, ``<name>.png``.
PHOTOS = (3, 4, 5, 7, 9, 10, 12, 16, 17, 18, 26, 30, 43, 44, 47, 48, 49, 50, 51, 53, 57, 58, 63, 255)
EVERYONE = "ffffffff"
TOPICS = ["msh/XX/2/json/#"]
#: The views' clock; the model's events end on 2024-01-30.
NOW = "2024-01-29 12:00:00"
LATER = "2024-01-31 00:30:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now_us() -> F.Column:
    return F.unix_micros(F.lit(NOW).cast("timestamp"))


def events(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """The packet log in arrival order ``seq``; with ``spread``, its rows are dealt out to all cores before anything is computed of them."""
    e = table(spark, sf_dir, "events")
    return (decode.spread(e, "event_id") if spread else e).select(
        F.col("event_id").alias("seq"), hex_id(F.col("user_id")).alias("from_id"), F.col("user_id").alias("from_num"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.col("event_type").alias("kind"), "value", "props", F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a broker would send it: (seq, ts_us, topic, body), bodies in JSON.

    Kinds follow the event types; some packets lack a payload or a field, some bodies are broken, some
    topics are not subscribed to, and some nodes announce another id than their own.
    """
    e = events(spark, sf_dir, spread=True)
    seq, num, k, value = F.col("seq"), F.col("from_num"), F.col("k"), F.col("value")
    every = lambda n, r=0: seq % n == r
    kind = F.col("kind")
    type_ = F.when(kind == "view", "telemetry").when(kind == "signup", "nodeinfo").when(kind == "purchase", "position").when(kind == "error", "neighborinfo").when(every(2), "text").otherwise("traceroute")
    name = F.concat(F.lit("Node "), num)
    payload = {
        "telemetry": F.when(~every(10), F.to_json(F.struct(k.alias("battery_level"), value.alias("voltage"), F.lit("fine").alias("state")))),
        "nodeinfo": F.to_json(F.struct(
            F.when(every(11), hex_id(num + 1000)).otherwise(F.concat(F.lit("!"), hex_id(num))).alias("id"), F.when(every(3), k).alias("hardware"), F.when(every(3, 1), k % 66).alias("hw_model"),
            F.when(every(2), name).alias("longname"), F.when(every(2, 1), F.concat(name, F.lit(" b"))).alias("long_name"), F.when(every(2), F.concat(F.lit("n"), num)).alias("shortname"),
            F.when(every(2, 1), F.concat(F.lit("N"), num)).alias("short_name"), F.when(~every(5), num % 11).alias("role"),
        )),
        "position": F.when(~every(13), F.to_json(F.struct((num * 1000003 % 1800000000 - 900000000).alias("latitude_i"), (num * 7000003 % 3600000000 - 1800000000).cast("int").alias("longitude_i"), k.alias("altitude")))),
        "neighborinfo": F.to_json(F.struct(num.alias("node_id"), F.lit(900).alias("node_broadcast_interval_secs"), F.when(every(2), 2).alias("neighbors_count"), F.array(F.struct(k.alias("node_id"), value.alias("snr")), F.struct((k + 50).alias("node_id"), (value / 2).alias("snr"))).alias("neighbors"))),
        "text": F.to_json(F.struct(F.concat(F.when(every(3), "TC BBS Commands ").otherwise("hello "), k).alias("text"))),
        "traceroute": F.to_json(F.struct(F.array(F.concat(F.lit("Node "), k), F.concat(F.lit("nobody "), k), F.concat(F.lit("Node "), k + 1, F.lit(" b"))).alias("route"))),
    }
    bodies = F.coalesce(*[F.when(type_ == t, p) for t, p in payload.items()])
    head = F.to_json(F.struct(
        seq.alias("id"), num.alias("from"), F.when(every(3), num + 1).otherwise(4294967295).alias("to"), F.concat(F.lit("!"), hex_id(num)).alias("sender"), F.when(~every(4), seq % 3).alias("channel"), type_.alias("type"),
        F.floor(F.col("ts_us") / 1_000_000).alias("timestamp"), (-k).alias("rssi"), value.alias("snr"), F.when(~every(4, 3), seq % 4).alias("hops_away"),
    ))
    body = F.when(every(97), "{broken").otherwise(F.concat(F.rtrim(head, F.lit("}")), F.coalesce(F.concat(F.lit(',"payload":'), bodies), F.lit("")), F.lit("}")))
    topic = F.concat(F.when(every(50), "other").otherwise("msh/XX"), F.lit("/2/json/Test/!"), hex_id(num))
    return e.select("seq", "ts_us", topic.alias("topic"), F.encode(body, "UTF-8").alias("body"))


def encoded(message: dict[str, tuple[int, str]], values: dict) -> bytes:
    """A message of the binary packet format; fields without a value are left out, lists are repeated fields."""

    def varint(v: int) -> bytes:
        v, out = v & (1 << 64) - 1, b""
        while v > 127:
            out, v = out + bytes([v & 127 | 128]), v >> 7
        return out + bytes([v])

    out = b""
    for name, (number, kind) in message.items():
        value = values.get(name)
        for v in value if isinstance(value, list) else [] if value is None else [value]:
            code = wire.KINDS[kind]
            raw = v.encode() if isinstance(v, str) else v
            body = varint(int(v)) if code == 0 else struct.pack("<f" if kind == "float" else "<i" if kind == "sfixed" else "<I", v) if code == 5 else varint(len(raw)) + raw
            out += varint(number << 3 | code) + body
    return out


@F.pandas_udf(T.BinaryType())
def data_of(seq: pd.Series, num: pd.Series, k: pd.Series, value: pd.Series, kind: pd.Series) -> pd.Series:
    """Port and payload of an event's packet."""
    ports = {name: port for port, name in decode.PORTS.items()}

    def one(seq: int, num: int, k: int, value: float, kind: str) -> bytes:
        name = f"Node {num}" + (" b" if seq % 2 else "")
        surroundings = {"temperature": value - 20, "relative_humidity": k / 2, "barometric_pressure": 900 + value, "gas_resistance": k * 3, "voltage": value / 2, "current": -value}
        payload = {
            "telemetry": lambda: encoded(wire.TELEMETRY, {"time": seq, "device_metrics": encoded(wire.DEVICE, {"battery_level": k, "voltage": value, "air_util_tx": value / 4}) if seq % 10 else None, "environment_metrics": encoded(wire.ENVIRONMENT, surroundings) if seq % 10 and seq % 4 == 0 else None}),
            "nodeinfo": lambda: encoded(wire.USER, {"id": f"{num + 1000:08x}" if seq % 11 == 0 else f"!{num:08x}", "hw_model": (k, k % 66, None)[seq % 3], "long_name": name, "short_name": f"{'nN'[seq % 2]}{num}", "role": num % 11 if seq % 5 else None}),
            "position": lambda: encoded(wire.POSITION, {"latitude_i": num * 1000003 % 1800000000 - 900000000, "longitude_i": num * 7000003 % 3600000000 - 1800000000, "altitude": k} if seq % 13 else {}),
            "neighborinfo": lambda: encoded(wire.NEIGHBORINFO, {"node_id": num, "node_broadcast_interval_secs": 900, "neighbors": [encoded(wire.NEIGHBOR, {"node_id": k + 50 * i, "snr": value / (i + 1)}) for i in (0, 1)]}),
            "text": lambda: f"{'hello ' if seq % 3 else 'TC BBS Commands '}{k}".encode(), "traceroute": lambda: encoded({"route": (wire.ROUTE, "bytes")}, {"route": struct.pack("<2I", k, k + 1)}),
        }[kind]()
        return encoded(wire.DATA, {"port": ports[kind], "payload": payload or None})

    return pd.Series([one(*x) for x in zip(seq, num, k, value, kind, strict=True)])


@F.pandas_udf(T.BinaryType())
def envelope_of(seq: pd.Series, num: pd.Series, k: pd.Series, value: pd.Series, data: pd.Series, cipher: pd.Series) -> pd.Series:
    def one(seq: int, num: int, k: int, value: float, data: bytes, cipher: bytes | None) -> bytes:
        head = {"from": num, "to": 4294967295 if seq % 3 else num + 1, "channel": seq % 3, "id": seq, "rx_time": 1_700_000_000, "rx_snr": value, "hop_limit": 3, "rx_rssi": -k}
        return encoded(wire.ENVELOPE, {"packet": encoded(wire.PACKET, head | ({"decoded": data} if cipher is None else {"encrypted": cipher})), "channel_id": "Test", "gateway_id": f"!{num:08x}"})

    return pd.Series([one(*x) for x in zip(seq, num, k, value, data, cipher, strict=True)])


def binary_messages(spark: SparkSession, sf_dir: str, keys: list[str]) -> DataFrame:
    """The log of ``messages`` in the binary format, as (seq, ts_us, topic, body); every other packet is encrypted, under one of the keys in turn."""
    e = events(spark, sf_dir, spread=True)
    seq, num, kind = F.col("seq"), F.col("from_num"), F.col("kind")
    type_ = F.when(kind == "view", "telemetry").when(kind == "signup", "nodeinfo").when(kind == "purchase", "position").when(kind == "error", "neighborinfo").when(seq % 2 == 0, "text").otherwise("traceroute")
    key = F.unbase64(F.element_at(F.array(*[F.lit(k) for k in keys]), (F.floor(seq / 2) % len(keys) + 1).cast("int")))
    e = e.withColumn("data", data_of(seq, num, "k", "value", type_))
    e = e.withColumn("cipher", F.when(seq % 2 == 1, decode.decrypted(F.col("data"), key, seq, num)))  # counter mode: encrypting is the same
    body = F.when(seq % 97 == 0, F.encode(F.lit("{broken"), "UTF-8")).otherwise(envelope_of(seq, num, "k", "value", "data", "cipher"))
    return e.select("seq", "ts_us", F.concat(F.when(seq % 50 == 0, "other").otherwise("msh/XX"), F.lit("/2/e/Test/!"), hex_id(num)).alias("topic"), body.alias("body"))


def packets(messages: DataFrame) -> DataFrame:
    """Subscribed messages as envelopes with typed payloads."""
    return decode.typed(decode.envelopes(decode.subscribed(messages, TOPICS)))


def hardware(spark: SparkSession) -> DataFrame:
    rows = [(code, name, f"{name}.png" if code in PHOTOS else None) for code, name in HARDWARE]
    return spark.createDataFrame(rows, "hardware int, name string, photo string")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select(
        hex_id(key).alias("id"), key.alias("num"), F.col("c_name").alias("longname"), F.right("c_name", F.lit(4)).alias("shortname"), (F.col("c_nationkey") % 11).cast("int").alias("role"),
        F.col("c_nationkey").alias("hardware"), (key * 7919 * 1009 % 1800000000 - 900000000).alias("lat_i"), (key * 104729 * 31 % 3600000000 - 1800000000).alias("lon_i"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest report of each neighbour: (src, dst, snr)."""
    e = events(spark, sf_dir).filter(F.col("k").isNotNull())
    return e.groupBy(F.col("from_num").alias("src"), F.col("k").alias("dst")).agg(F.max_by("value", "seq").alias("snr"))


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("channel"), F.col("turn").alias("id"), F.col("role").alias("sender"), "text", F.col("conv_id").alias("from_num"))


def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, at, hop): the hops of routes, one row each; a route is an order, its hops the suppliers in line order."""
    l = table(spark, sf_dir, "lineitem")
    return l.select(F.col("l_orderkey").alias("seq"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("at"), F.col("l_suppkey").alias("hop"))


def in_order(value: Column) -> Column:
    """The hops' values as an array, in the order of the hops."""
    return F.transform(F.sort_array(F.collect_list(F.struct("at", value.alias("value")))), lambda x: x["value"])


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, from_num): who asked for each route."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("from_num"))


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One route an order: (seq, from_num, hops)."""
    return heads(spark, sf_dir).join(hops(spark, sf_dir).groupBy("seq").agg(in_order(F.col("hop")).alias("hops")), "seq").select("seq", "from_num", "hops")


def roles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ROLES), "role int, title string, abbreviation string")
