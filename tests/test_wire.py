"""The binary format read a batch at a time, against a reader of one message in plain Python; decryption; malformed bytes."""

import random
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from radiolake.plans.packets import KEYS
from radiolake.sources import decode, wire
from radiolake.sources.model import encoded


def plain_fields(data):
    """[(number, wire type, value)] of one message, or None if it is malformed."""
    out, at = [], 0

    def varint():
        nonlocal at
        value = 0
        for i in range(10):
            if at >= len(data):
                raise ValueError
            byte = data[at]
            at += 1
            value |= (byte & 127) << 7 * i
            if byte < 128:
                return value & (1 << 64) - 1
        raise ValueError

    try:
        while at < len(data):
            tag = varint()
            number, kind = tag >> 3, tag & 7
            if not number or kind not in (0, 1, 2, 5):
                return None
            if kind == 0:
                out.append((number, kind, varint()))
                continue
            size = {1: 8, 5: 4}.get(kind) or varint() if kind != 2 else varint()
            if at + size > len(data):
                return None
            out.append((number, kind, bytes(data[at : at + size])))
            at += size
    except ValueError:
        return None
    return out


def test_scan_is_the_plain_reader():
    rng = random.Random(4)
    whole = [
        encoded({"a": (1, "uint"), "b": (2, "bytes"), "c": (3, "fixed"), "d": (700, "int"), "e": (2, "string")}, {"a": [rng.getrandbits(rng.choice([1, 7, 8, 32, 63])) for _ in range(rng.randrange(3))], "b": [rng.randbytes(rng.randrange(9))] * rng.randrange(3), "c": rng.getrandbits(32), "d": -rng.randrange(99), "e": "é" * rng.randrange(70)})
        for _ in range(300)
    ]
    messages = [*whole, b"", *(m[: rng.randrange(len(m))] for m in whole), *(rng.randbytes(rng.randrange(12)) for _ in range(2000)), b"\xff" * 12, b"\x09" + bytes(8), b"\x09" + bytes(7)]
    column = pa.array(messages, pa.binary())
    found = wire.scan(*wire.buffer_of(column))
    for i, m in enumerate(messages):
        expected = plain_fields(m)
        assert bool(found.bad[i]) == (expected is None), m
        if expected is not None:
            own = np.flatnonzero(found.row == i)
            got = [(n, k, v if k == 0 else bytes(found.data[a:b])) for n, k, v, a, b in zip(*(x[own].tolist() for x in (found.number, found.kind, found.value, found.start, found.end)), strict=True)]
            assert got == expected
    part = wire.scan(*wire.buffer_of(column.slice(100, 50)))
    assert part.rows == 50 and part.bad.tolist() == found.bad[100:150].tolist()


def rows_of(spark, bodies, keys=KEYS, topic="msh/XX/2/e/a"):
    df = spark.createDataFrame([(i, i * 1000, topic, bytearray(b)) for i, b in enumerate(bodies)], "seq long, ts_us long, topic string, body binary")
    return [r.asDict(True) for r in decode.binary(df, keys).orderBy("seq").collect()]


def packet(port, payload, **head):
    return encoded(wire.ENVELOPE, {"packet": encoded(wire.PACKET, {"from": 10, "to": 4294967295, "id": 77, "decoded": encoded(wire.DATA, {"port": port, "payload": payload}), **head})})


def test_every_kind(spark):
    metrics = {"device_metrics": encoded(wire.DEVICE, {"battery_level": 90, "voltage": 3.5}), "environment_metrics": encoded(wire.ENVIRONMENT, {"temperature": -4.25})}
    near = [encoded(wire.NEIGHBOR, {"node_id": 5, "snr": -7.5}), encoded(wire.NEIGHBOR, {"node_id": 6})]
    out = rows_of(spark, [
        packet(1, "naïve".encode()), packet(1, b"\xff\xfe"), packet(3, encoded(wire.POSITION, {"latitude_i": -450000000, "altitude": -12})), packet(4, encoded(wire.USER, {"id": "!0000000a", "long_name": "L", "hw_model": 43})),
        packet(5, encoded(wire.ROUTING, {"error_reason": 5})), packet(67, encoded(wire.TELEMETRY, metrics)), packet(67, encoded(wire.TELEMETRY, {"device_metrics": metrics["device_metrics"]})), packet(67, encoded(wire.TELEMETRY, {"time": 4})),
        packet(70, encoded({"r": (1, "bytes")}, {"r": struct.pack("<2I", 10, 4294967295)})), packet(70, encoded({"r": (1, "fixed")}, {"r": [1, 2]})), packet(71, encoded(wire.NEIGHBORINFO, {"node_id": 10, "neighbors": near})),
        packet(73, encoded(wire.POSITION, {"longitude_i": 7})), packet(200, b"x"), packet(3, None), packet(3, b"\x0d\x00"), b"", b"{broken", packet(1, b"cut")[:-2], packet(71, encoded(wire.NEIGHBORINFO, {"node_id": 3})),
    ])
    kinds = ["text", "unknown", "position", "nodeinfo", "routing", "telemetry", "telemetry", "telemetry", "traceroute", "traceroute", "neighborinfo", "mapreport", "unknown", "position", "unknown", "unknown", "unknown", "unknown", "neighborinfo"]
    assert [r["type"] for r in out] == kinds
    assert out[0]["text"] == {"text": "naïve"} and out[0]["from"] == "0000000a" and out[0]["to"] == "ffffffff"
    assert (out[2]["position"]["latitude_i"], out[2]["position"]["altitude"], out[2]["position"]["longitude_i"]) == (-450000000, -12, None)
    assert (out[3]["nodeinfo"]["id"], out[3]["nodeinfo"]["long_name"], out[3]["nodeinfo"]["hw_model"], out[3]["nodeinfo"]["role"]) == ("0000000a", "L", 43, None)
    assert out[4]["routing"] == {"error_reason": 5} and out[5]["telemetry"] == {"temperature": "-4.25"} and out[6]["telemetry"] == {"battery_level": "90", "voltage": "3.5"} and out[7]["telemetry"] is None
    assert out[8]["traceroute"] == {"route": ["0000000a", "ffffffff"]} and out[9]["traceroute"] == {"route": ["00000001", "00000002"]}
    assert [(n["node_id"], n["snr"]) for n in out[10]["neighborinfo"]["neighbors"]] == [(5, -7.5), (6, None)] and out[10]["neighborinfo"]["neighbors_count"] == 2
    assert out[11]["mapreport"]["longitude_i"] == 7 and out[11]["position"] is None and out[13]["position"]["altitude"] is None and out[18]["neighborinfo"]["neighbors"] == []
    assert [out[i]["from"] for i in (15, 16, 17)] == [None] * 3


def test_keys(spark):
    """The right key of several, a wrong one, none, and bytes that are no ciphertext."""
    data = encoded(wire.DATA, {"port": 1, "payload": b"secret text of more than one block"})
    e = spark.createDataFrame([(bytearray(data),)], "d binary")
    ciphers = [bytes(e.select(decode.decrypted(F.col("d"), F.unbase64(F.lit(k)), F.lit(77).cast("long"), F.lit(10).cast("long"))).first()[0]) for k in KEYS]
    bodies = [encoded(wire.ENVELOPE, {"packet": encoded(wire.PACKET, {"from": 10, "id": 77, "encrypted": c})}) for c in [*ciphers, b"", b"noise" * 9]]
    assert [(r["type"], r["text"] and r["text"]["text"]) for r in rows_of(spark, bodies)] == [("text", "secret text of more than one block")] * 2 + [("unknown", None)] * 2
    assert [r["type"] for r in rows_of(spark, bodies, KEYS[:1])] == ["text", "unknown", "unknown", "unknown"]
    assert [r["type"] for r in rows_of(spark, bodies, [])] == ["unknown"] * 4
    assert rows_of(spark, bodies[:1], topic="msh/XX/2/json/a") == [] and rows_of(spark, []) == []


def test_a_wrong_key_that_reads():
    """Of streams that all give a message with a port, the one counts whose message can be meant."""
    position = encoded(wire.DATA, {"port": 3, "payload": encoded(wire.POSITION, {"altitude": 5})})
    right = [position, position, position, encoded(wire.DATA, {"port": 3}), encoded(wire.DATA, {"port": 1, "payload": b"hello"}), encoded(wire.DATA, {"port": 200, "payload": b"x"}), encoded(wire.DATA, {"port": 70})]
    wrong = [b"\x08\x7f\x50\x01\x50\x01", b"\x08\x03\x12\x02\x0d\x01", b"\x08\x03\x18\x01\x18\x01", b"\x08\x46", b"\x08\x01\x18\x01\x60\x01\x60\x01\x00"[: len(encoded(wire.DATA, {"port": 1, "payload": b"hello"}))], b"\x08\x7f\x10\x01\x18\x01"[:6], b"\x08\x01"]
    for r, w in zip(right, wrong, strict=True):
        assert len(r) == len(w) or w[1] == 0x7F
        w = w[: len(r)]
        cipher, no_key = bytes(x ^ 0x5A for x in r), bytes([0x5A]) * len(r)
        other = bytes(a ^ b for a, b in zip(cipher, w, strict=True))
        for streams in ([other, no_key], [no_key, other]):
            found = wire.opened(pa.array([cipher], pa.binary()), pa.array([streams], pa.list_(pa.binary())), decode.PORTS).to_pylist()[0]
            expected = wire.packets(pa.array([encoded(wire.ENVELOPE, {"packet": encoded(wire.PACKET, {"decoded": r})})], pa.binary())).to_pylist()[0]
            assert (found["port"], found["data"]) == (expected["port"], expected["data"]), (r, w)


def test_names_and_units(spark):
    from radiolake.functions import mesh as m

    row = spark.sql("select map('voltage', '3.456', 'voltage_ch2', '1', 'temperature', '-4.25', 'battery_level', 'USB', 'channel_utilization', '7.25') t, '' a, ' town ' b, cast(null as string) c")
    shown = row.select(*[m.shown(F.col("t"), n).alias(n) for n in ("voltage", "voltage_ch2", "temperature", "battery_level", "channel_utilization", "current")], m.place_name(F.col("a"), F.col("b"), F.col("c"), F.lit("land")).alias("p"), m.place_name(F.col("a"), F.col("c")).alias("none")).first()
    assert tuple(shown) == ("3.46 V", "1.00 V", "-4.25°C", "USB", "7.3%", None, "town, land", None)
