"""Binary packets: the tag-length-value wire format, read for a whole batch of messages at a time.

All messages of a batch step from field to field together, so the steps are as many as the longest message has fields. What is
found is one flat table of fields; nested messages are read in the same way from the spans of their fields. Fields that aren't asked for, or have
another wire type than theirs, are skipped; of a repeated scalar the last counts, as the format says.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Field numbers and types of the packet format's messages.
ENVELOPE = {"packet": (1, "message"), "channel_id": (2, "string"), "gateway_id": (3, "string")}
PACKET = {
    "from": (1, "fixed"), "to": (2, "fixed"), "channel": (3, "uint"), "decoded": (4, "message"), "encrypted": (5, "bytes"), "id": (6, "fixed"), "rx_time": (7, "fixed"), "rx_snr": (8, "float"),
    "hop_limit": (9, "uint"), "want_ack": (10, "bool"), "priority": (11, "uint"), "rx_rssi": (12, "int"), "hop_start": (15, "uint"),
}
DATA = {"port": (1, "uint"), "payload": (2, "bytes")}
#: Wire types of all fields that the format gives ``DATA``, those that aren't read too.
DATA_FIELDS = {1: 0, 2: 2, 3: 0, 4: 5, 5: 5, 6: 5, 7: 5, 8: 5, 9: 0}
#: Kinds that are sent without a payload, as requests, the more frequent one with the higher value.
EMPTY = {"position": 2, "traceroute": 1}
POSITION = {
    "latitude_i": (1, "sfixed"), "longitude_i": (2, "sfixed"), "altitude": (3, "int"), "time": (4, "fixed"), "timestamp": (7, "fixed"), "PDOP": (11, "uint"), "ground_speed": (15, "uint"),
    "ground_track": (16, "uint"), "sats_in_view": (19, "uint"), "precision_bits": (23, "uint"),
}
USER = {"id": (1, "string"), "long_name": (2, "string"), "short_name": (3, "string"), "hw_model": (5, "uint"), "role": (7, "uint")}
NEIGHBORINFO = {"node_id": (1, "uint"), "last_sent_by_id": (2, "uint"), "node_broadcast_interval_secs": (3, "uint"), "neighbors": (4, "message")}
NEIGHBOR = {"node_id": (1, "uint"), "snr": (2, "float"), "last_rx_time": (3, "fixed"), "node_broadcast_interval_secs": (4, "uint")}
TELEMETRY = {"time": (1, "fixed"), "device_metrics": (2, "message"), "environment_metrics": (3, "message")}
DEVICE = {"battery_level": (1, "uint"), "voltage": (2, "float"), "channel_utilization": (3, "float"), "air_util_tx": (4, "float")}
ENVIRONMENT = {"temperature": (1, "float"), "relative_humidity": (2, "float"), "barometric_pressure": (3, "float"), "gas_resistance": (4, "float"), "voltage": (5, "float"), "current": (6, "float")}
ROUTING = {"error_reason": (3, "uint")}
ROUTE = 1  # repeated fixed32, packed or not
KINDS = {"uint": 0, "int": 0, "bool": 0, "fixed": 5, "sfixed": 5, "float": 5, "string": 2, "bytes": 2, "message": 2}


@dataclass
class Fields:
    """A flat table of the fields of ``rows`` messages, and which messages are malformed."""

    data: np.ndarray
    rows: int
    row: np.ndarray
    number: np.ndarray
    kind: np.ndarray
    value: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bad: np.ndarray

    def last(self, field: tuple[int, str]) -> tuple[np.ndarray, np.ndarray]:
        """(places in this table, whether there is one) of the last such field of each message."""
        number, kind = field
        at = np.flatnonzero((self.number == number) & (self.kind == KINDS[kind]))
        out = np.full(self.rows, -1, np.int64)
        np.maximum.at(out, self.row[at], at)
        return np.maximum(out, 0), (out >= 0) & ~self.bad

    def spans(self, field: tuple[int, str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, whether there is one) of a field of bytes; of none an empty span."""
        at, there = self.last(field)
        if not len(self.row):
            return np.zeros(self.rows, np.int64), np.zeros(self.rows, np.int64), there
        return np.where(there, self.start[at], 0), np.where(there, self.end[at], 0), there

    def column(self, field: tuple[int, str]) -> pa.Array:
        at, there = self.last(field)
        if KINDS[field[1]] == 2:
            start, end, there = self.spans(field)
            raw = self.data.tobytes()
            found = [raw[a:b] if t else None for a, b, t in zip(start.tolist(), end.tolist(), there.tolist(), strict=True)]
            return pa.array([None if x is None else x.decode("utf-8", "replace") for x in found], pa.string()) if field[1] == "string" else pa.array(found, pa.binary())
        value = self.value[at] if len(self.row) else np.zeros(self.rows, np.uint64)
        if field[1] == "float":
            return pa.array(value.astype(np.uint32).view(np.float32).astype(np.float64), mask=~there)
        if field[1] == "bool":
            return pa.array(value != 0, mask=~there)
        whole = value.astype(np.uint32).view(np.int32).astype(np.int64) if field[1] in ("sfixed", "int") else (value & 0xFFFFFFFF).astype(np.int64)
        return pa.array(whole, mask=~there)

    def struct(self, message: dict[str, tuple[int, str]], there: np.ndarray | None = None) -> pa.StructArray:
        return pa.StructArray.from_arrays([self.column(f) for f in message.values()], list(message), mask=None if there is None else pa.array(~there))


def varints(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, places behind them, whether they end within their message and ten bytes)."""
    value, at, open_ = np.zeros(len(at), np.uint64), at.copy(), np.ones(len(at), bool)
    ok = np.ones(len(at), bool)
    for i in range(10):
        ok &= ~(open_ & (at >= end))
        open_ &= ok
        if not open_.any():
            break
        byte = data[np.where(open_, at, 0)].astype(np.uint64)
        value |= np.where(open_, (byte & np.uint64(127)) << np.uint64(7 * i), np.uint64(0))
        at += open_
        open_ = open_ & (byte >= 128)
    return value, at, ok & ~open_


def scan(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Fields:
    """The fields of the messages that lie between ``start`` and ``end`` in ``data``."""
    data = np.append(data, np.zeros(8, np.uint8))
    at, bad, parts = start.astype(np.int64).copy(), np.zeros(len(start), bool), []
    rows = np.flatnonzero(at < end)
    while len(rows):
        stop = end[rows]
        tag, here, ok = varints(data, at[rows], stop)
        kind, number = (tag & np.uint64(7)).astype(np.int64), (tag >> np.uint64(3)).astype(np.int64)
        ok &= (number > 0) & np.isin(kind, (0, 1, 2, 5))
        value, behind, whole = varints(data, here, np.where((kind == 0) | (kind == 2), stop, here + 10))
        ok &= whole | (kind == 1) | (kind == 5)
        first = np.where(kind == 2, behind, here)
        size = np.select([kind == 1, kind == 5, kind == 2], [8, 4, np.minimum(value, np.uint64(1 << 40)).astype(np.int64)], behind - here)
        last = first + size
        ok &= last <= stop
        four = np.flatnonzero(ok & (kind == 5))
        value[four] = (data[first[four][:, None] + np.arange(4)].astype(np.uint64) << (np.uint64(8) * np.arange(4, dtype=np.uint64))).sum(1)
        bad[rows[~ok]] = True
        at[rows] = np.where(ok, last, stop)
        rows = rows[ok]
        parts.append((rows, number[ok], kind[ok], value[ok], first[ok], last[ok]))
        rows = rows[at[rows] < end[rows]]
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 6
    return Fields(data, len(start), *columns, bad)


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end) of a column of binaries; of null an empty span."""
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), bounds[:-1], bounds[1:]


def packets(bodies: pa.Array) -> pa.Array:
    """Envelopes as the columns of their packets, with ``port`` and ``data`` of plain ones; all null where malformed."""
    outer = scan(*buffer_of(bodies))
    start, end, there = outer.spans(ENVELOPE["packet"])
    inner = scan(outer.data, start, end)
    inner.bad |= ~there
    plain_start, plain_end, plain = inner.spans(PACKET["decoded"])
    data = scan(outer.data, plain_start, plain_end)
    data.bad |= ~plain
    names = [k for k in PACKET if k != "decoded"]
    columns = [inner.column(PACKET[k]) for k in names] + [data.column(DATA["port"]), data.column(DATA["payload"])]
    return pa.StructArray.from_arrays(columns, [*names, "port", "data"])


def opened(encrypted: pa.Array, streams: pa.Array, kinds: dict[int, str]) -> pa.StructArray:
    """Port and data under the key stream whose plaintext is a whole message with a port; null under none.

    Foreign bytes are such a message now and then (of all pairs of bytes one is, for each small port), so where several streams give one, that
    counts which can best be meant: of a known port whose payload can be read, with a payload, of the format's own fields; then the first.
    """
    n, keys = len(encrypted), max((len(s) for s in streams.to_pylist() if s), default=0)
    data, start, end = buffer_of(encrypted)
    size = end - start
    bounds = np.append(0, np.cumsum(size))
    flat = data[start[0] : end[-1]] if n else data
    streams = streams.to_pylist()
    read: list[list[tuple[int, bytes | None, bool]]] = [[] for _ in range(n)]
    for k in range(keys):
        key = np.frombuffer(b"".join((s[k][:z] if s else bytes(z)) for s, z in zip(streams, size.tolist(), strict=True)), np.uint8)
        plain = scan(flat ^ key, bounds[:-1], bounds[1:])
        _, there = plain.last(DATA["port"])
        foreign = np.zeros(n, bool)
        foreign[plain.row[[DATA_FIELDS.get(f) != w for f, w in zip(plain.number.tolist(), plain.kind.tolist(), strict=True)]]] = True
        ports, bodies = plain.column(DATA["port"]).to_pylist(), plain.column(DATA["payload"]).to_pylist()
        for i in np.flatnonzero(there & (size > 0)).tolist():
            read[i].append((ports[i], bodies[i], bool(foreign[i])))
    contested = [(i, x) for i, found in enumerate(read) if len(found) > 1 for x in found]
    if contested:
        as_kinds = payloads(pa.array([x[0] for _, x in contested], pa.int64()), pa.array([x[1] or b"" for _, x in contested], pa.binary()), kinds)
        best: dict[int, tuple] = {}
        for (i, x), kind, whole in zip(contested, as_kinds.field("kind").to_pylist(), as_kinds.field("whole").to_pylist(), strict=True):
            meant = (kind != "unknown" and whole, 3 if x[1] else EMPTY.get(kind, 0), not x[2])
            if i not in best or meant > best[i]:
                best[i], read[i] = meant, [x]
    ports, bodies = [x[0][0] if x else None for x in read], [x[0][1] if x else None for x in read]
    return pa.StructArray.from_arrays([pa.array(ports, pa.int64()), pa.array(bodies, pa.binary())], ["port", "data"])


def payloads(ports: pa.Array, bodies: pa.Array, kinds: dict[int, str]) -> pa.StructArray:
    """Every kind's payload as a struct, null for other kinds; ``whole`` tells whether it could be read."""
    kind = np.array([kinds.get(p, "unknown") for p in ports.to_pylist()])
    data, start, end = buffer_of(bodies)
    plain = np.isin(kind, ("position", "mapreport", "nodeinfo", "neighborinfo", "telemetry", "traceroute", "routing"))
    top = scan(data, start, np.where(plain, end, start))
    is_ = lambda *k: np.isin(kind, k) & ~top.bad
    near = np.flatnonzero((top.number == NEIGHBORINFO["neighbors"][0]) & (top.kind == 2) & is_("neighborinfo")[top.row])
    near = near[np.argsort(top.row[near], kind="stable")]
    each = scan(top.data, top.start[near], top.end[near])
    counts = np.bincount(top.row[near], minlength=len(kind))
    neighbors = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), each.struct(NEIGHBOR))
    info = {k: v for k, v in NEIGHBORINFO.items() if k != "neighbors"}
    neighborinfo = pa.StructArray.from_arrays([*[top.column(f) for f in info.values()], neighbors], [*info, "neighbors"], mask=pa.array(~is_("neighborinfo")))
    metrics = []
    for name, fields in (("device_metrics", DEVICE), ("environment_metrics", ENVIRONMENT)):
        a, b, there = top.spans(TELEMETRY[name])
        there = there & is_("telemetry")
        inner = scan(top.data, np.where(there, a, 0), np.where(there, b, 0))
        metrics.append(inner.struct(fields, there & ~inner.bad))
    routes = np.flatnonzero((top.number == ROUTE) & np.isin(top.kind, (2, 5)) & is_("traceroute")[top.row])
    hops: list[list[int] | None] = [[] if t else None for t in is_("traceroute").tolist()]
    for i in routes[np.argsort(top.row[routes], kind="stable")].tolist():
        one = top.data[top.start[i] : top.end[i]]
        hops[top.row[i]] += one[: len(one) // 4 * 4].view("<u4").tolist()
    text = [None] * len(kind)
    raw = data.tobytes()
    for i in np.flatnonzero(kind == "text").tolist():
        try:
            text[i] = raw[start[i] : end[i]].decode()
        except UnicodeDecodeError:
            pass
    whole = np.where(kind == "text", [t is not None for t in text], ~top.bad)
    columns = {
        "kind": pa.array(kind.astype(object), pa.string()), "whole": pa.array(whole), "text": pa.array(text, pa.string()), "position": top.struct(POSITION, is_("position")), "mapreport": top.struct(POSITION, is_("mapreport")),
        "nodeinfo": top.struct(USER, is_("nodeinfo")), "neighborinfo": neighborinfo, "device": metrics[0], "environment": metrics[1], "route": pa.array(hops, pa.list_(pa.int64())), "routing": top.struct(ROUTING, is_("routing")),
    }
    return pa.StructArray.from_arrays(list(columns.values()), list(columns))


SQL = {"uint": "long", "int": "long", "fixed": "long", "sfixed": "long", "float": "double", "bool": "boolean", "string": "string", "bytes": "binary"}


def ddl(message: dict[str, tuple[int, str]]) -> str:
    return "struct<" + ",".join(f"`{k}`:{SQL[t]}" for k, (_, t) in message.items() if t != "message") + ">"


PACKETS = ddl(PACKET)[:-1] + ",port:long,data:binary>"
OPENED = "struct<port:long,data:binary>"
PAYLOADS = (
    f"struct<kind:string,whole:boolean,text:string,position:{ddl(POSITION)},mapreport:{ddl(POSITION)},nodeinfo:{ddl(USER)},"
    f"neighborinfo:{ddl(NEIGHBORINFO)[:-1]},neighbors:array<{ddl(NEIGHBOR)}>>,device:{ddl(DEVICE)},environment:{ddl(ENVIRONMENT)},route:array<long>,routing:{ddl(ROUTING)}>"
)
