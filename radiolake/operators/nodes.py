"""Node state as a fold of decoded packets, and the records that views show of it.

Every kind of packet sets its own fields of a node; the newest packet that sets a field decides it.
The key is the sender, of a nodeinfo packet the id that it announces. A text marks a node only if an
earlier packet of another kind made it known; a traceroute marks none. ``fold_nodes`` is one
aggregation of built-in functions, so the same expressions run over a table and over a stream.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiolake.functions.mesh import degrees_of, distance_km, first_known, has_markers, has_position, hex_id, known_id, uptime
from radiolake.operators.state import is_active
from radiolake.sources import decode

#: Texts that have all of these mark their sender as a bulletin board.
BOARD_MARKERS = ("TC", "BBS", "Commands")
FOLDED = ("nodeinfo", "position", "telemetry", "neighborinfo", "text")
FIELDS = ("hardware", "longname", "shortname", "role", "position", "telemetry", "neighborinfo")
UNKNOWN_LONG, UNKNOWN_SHORT = "Unknown", "UNK"


def node_key(packets: DataFrame) -> DataFrame:
    """Packets that touch a node, with its id; those without a usable id touch none."""
    announced = known_id(F.col("nodeinfo.id"))
    key = F.when(F.col("type") == "nodeinfo", announced).otherwise(F.col("from"))
    return packets.filter(F.col("type").isin(*FOLDED)).withColumn("id", key).filter(F.col("id").isNotNull())


def field_values() -> dict[str, tuple[Column, Column]]:
    """(value, whether a packet sets it) of each field, in the order of precedence of its names."""
    info = F.col("type") == "nodeinfo"
    hardware = first_known(F.col("nodeinfo.hardware"), F.col("nodeinfo.hw_model"))
    longname = first_known(F.col("nodeinfo.longname"), F.col("nodeinfo.long_name"))
    shortname = first_known(F.col("nodeinfo.shortname"), F.col("nodeinfo.short_name"))
    named = {"hardware": hardware, "longname": longname, "shortname": shortname}
    out = {k: (v, info & v.isNotNull()) for k, v in named.items()}
    out["role"] = (F.coalesce("nodeinfo.role", F.lit(0)), info)
    return out | {k: (F.col(k), F.col("type") == k) for k in ("position", "telemetry", "neighborinfo")}


def fold_nodes(packets: DataFrame, markers: tuple[str, ...] = BOARD_MARKERS) -> DataFrame:
    """Per node the newest (seq, value) of every field, and when it was heard."""
    text, seq, heard = F.col("type") == "text", F.col("seq"), F.struct("seq", "ts_us")
    fields = []
    for name, (value, sets) in field_values().items():
        fields += [F.max_by(value, F.when(sets, seq)).alias(name), F.max(F.when(sets, seq)).alias(f"{name}_seq")]
    return node_key(packets).groupBy("id").agg(
        F.min(F.when(~text, seq)).alias("known_seq"), F.max(F.when(~text, heard)).alias("heard"), F.max(F.when(text, heard)).alias("texted"),
        F.max(F.when(text & has_markers(F.col("text.text"), *markers), seq)).alias("board_seq"), *fields,
    )


def touches(messages: DataFrame) -> DataFrame:
    """Of a log of JSON messages what touches a node: (id, seq, ts_us, type, payload) with the fields of nodeinfo payloads; only routing fields and these are decoded."""
    kind = F.col("type")
    rows = decode.routed(messages).filter(kind.isin(*FOLDED))
    rows = decode.parsed(rows.withColumnRenamed("from", "sent_by"), F.when(kind == "nodeinfo", F.col("payload")), decode.NODEINFO)
    return rows.withColumn("id", F.when(kind == "nodeinfo", known_id(F.col("id"))).otherwise(F.col("sent_by"))).drop("sent_by").filter("id is not null")


def latest_seqs(messages: DataFrame, markers: tuple[str, ...] = BOARD_MARKERS) -> DataFrame:
    """Per node the ``seq`` of the packet that decides each field; only routing fields, and the payloads of two kinds, are read.

    All aggregates are longs, so this is a hash aggregation whose rows are as small as its keys, combined before the shuffle.
    """
    kind, seq, rows = F.col("type"), F.col("seq"), touches(messages)
    marked = has_markers(F.from_json(F.when(kind == "text", F.col("payload")), decode.TEXT)["text"], *markers)
    sets = {
        "known": kind != "text", "heard": kind != "text", "texted": kind == "text", "board": marked, "role": kind == "nodeinfo",
        "hardware": first_known(F.col("hardware"), F.col("hw_model")).isNotNull(), "longname": first_known(F.col("longname"), F.col("long_name")).isNotNull(),
        "shortname": first_known(F.col("shortname"), F.col("short_name")).isNotNull(), **{k: kind == k for k in ("position", "telemetry", "neighborinfo")},
    }
    return rows.groupBy("id").agg(*[(F.min if k == "known" else F.max)(F.when(v, seq)).alias(f"{k}_seq") for k, v in sets.items()])


def fold_log(messages: DataFrame, markers: tuple[str, ...] = BOARD_MARKERS) -> DataFrame:
    """``fold_nodes`` of a log of messages in two phases: which packet decides each field, then only those packets are decoded.

    The first phase's exchange serves both its uses, so its columns are the same in both. The second reads the log again through a semi join
    with the deciding packets, at most eleven a node: a broadcast, or a filter on the scan, as their number allows.
    """
    seqs = latest_seqs(messages, markers)
    of = [c for c in seqs.columns if c != "id"]
    deciding = seqs.select(F.explode(F.array(*of)).alias("seq")).filter("seq is not null")
    packets = node_key(decode.typed(decode.envelopes(messages.join(deciding, "seq", "left_semi"))))
    values = [v.alias(k) for k, (v, _) in field_values().items()]
    found = packets.groupBy("id").agg(F.collect_list(F.struct("seq", "ts_us", *values)).alias("found"))  # a node's deciding packets, at most eleven
    rows = seqs.join(found, "id")

    def decided(field: str) -> Column:
        return F.get(F.filter("found", lambda x: x["seq"] == F.col(f"{field}_seq")), F.lit(0))

    heard = [F.when(F.col(f"{c}_seq").isNotNull(), F.struct(F.col(f"{c}_seq").alias("seq"), decided(c)["ts_us"].alias("ts_us"))).alias(c) for c in ("heard", "texted")]
    fields = [x for k in FIELDS for x in (decided(k)[k].alias(k), F.col(f"{k}_seq"))]
    return rows.select("id", "known_seq", *heard, "board_seq", *fields)


def merge_nodes(one: DataFrame, two: DataFrame) -> DataFrame:
    """Folds of two parts of a log, in any order, as the fold of both."""
    both = one.alias("a").join(two.alias("b"), "id", "full")
    out = [F.least("a.known_seq", "b.known_seq").alias("known_seq")]
    out += [F.greatest(f"a.{c}", f"b.{c}").alias(c) for c in ("heard", "texted", "board_seq")]
    for c in FIELDS:
        newer = F.coalesce(F.col(f"a.{c}_seq") >= F.col(f"b.{c}_seq"), F.col(f"b.{c}_seq").isNull())
        out += [F.when(newer, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c), F.greatest(f"a.{c}_seq", f"b.{c}_seq").alias(f"{c}_seq")]
    return both.select("id", *out)


def default_nodes(ids: DataFrame) -> DataFrame:
    """Rows of ``ids(id)`` as a node nothing is known of; everyone's address has names of its own."""
    everyone = F.col("id") == "ffffffff"
    return ids.select("id", F.when(everyone, "Everyone").otherwise(UNKNOWN_LONG).alias("longname"), F.when(everyone, "ALL").otherwise(UNKNOWN_SHORT).alias("shortname"), F.lit(None).cast("int").alias("hardware"), F.lit(None).cast("int").alias("role"), F.lit(False).alias("active"))


def known_nodes(folded: DataFrame, now_us: Column, inactive_s: int = 7200) -> DataFrame:
    """The fold as nodes: defaults for what no packet set, ``last_us``, ``active`` and ``board``."""
    texted = F.when(F.col("texted.seq") > F.col("known_seq"), F.col("texted"))
    last = F.greatest("heard", texted)
    nodes = folded.filter(F.col("known_seq").isNotNull()).select(
        "id", F.coalesce("longname", F.lit(UNKNOWN_LONG)).alias("longname"), F.coalesce("shortname", F.lit(UNKNOWN_SHORT)).alias("shortname"), "hardware", "role",
        "position", "telemetry", "neighborinfo", F.coalesce(F.col("board_seq") > F.col("known_seq"), F.lit(False)).alias("board"), last["ts_us"].alias("last_us"),
    )
    return nodes.withColumn("active", is_active(F.col("last_us"), now_us, inactive_s))


def matching(nodes: DataFrame, now_us: Column, days: int | None = None, ids: list[str] | None = None, long_name: str | None = None, short_name: str | None = None, status: str | None = None) -> DataFrame:
    """Nodes that pass every filter that is given; unknown statuses filter nothing."""
    tests = []
    if days is not None:
        tests.append(F.floor((now_us - F.col("last_us")) / 86_400_000_000) <= max(days, 1))
    if ids:
        tests.append(F.col("id").isin(*ids))
    for column, part in (("longname", long_name), ("shortname", short_name)):
        if part is not None and part.strip():
            tests.append(F.contains(F.lower(column), F.lit(part.strip().lower())))
    if status in ("online", "offline"):
        tests.append(F.col("active") if status == "online" else ~F.col("active"))
    return nodes.filter(reduce(lambda a, b: a & b, tests, F.lit(True)))


def position_record(position: Column) -> Column:
    """Altitude and degrees; null members for what is unknown."""
    return F.struct(position["altitude"].alias("altitude"), degrees_of(position["latitude_i"]).alias("latitude"), degrees_of(position["longitude_i"]).alias("longitude"))


def node_records(nodes: DataFrame, host: DataFrame | None = None) -> DataFrame:
    """What lists show of a node; with ``host(lat, lon)`` of one row, the distance from it too."""
    at = position_record(F.col("position"))
    out = nodes.select(
        "id", "longname", "shortname", "hardware", "role", at.alias("position"), F.col("telemetry")["battery_level"].try_cast("double").alias("battery_level"), F.col("telemetry")["voltage"].try_cast("double").alias("voltage"),
        F.coalesce("neighborinfo.neighbors_count", F.size("neighborinfo.neighbors")).alias("neighbors"), "board", "last_us", "active",
    )
    out = out.withColumn("neighbors", F.when(F.col("neighbors") >= 0, F.col("neighbors")))
    if host is None:
        return out
    here = F.broadcast(host.limit(1).select(F.col("lat").alias("__lat"), F.col("lon").alias("__lon")))  # one row
    placed = has_position(F.col("position.latitude"), F.col("position.longitude"))
    dx = F.when(placed, distance_km(F.col("__lat"), F.col("__lon"), F.col("position.latitude"), F.col("position.longitude")))
    return out.crossJoin(here).withColumn("dx_km", dx).drop("__lat", "__lon")


def summary(nodes: DataFrame, messages: DataFrame, started_us: Column, now_us: Column) -> DataFrame:
    """One row on the mesh: nodes known and online, messages since the start, and the time since then."""
    counted = nodes.agg(F.count("*").alias("known_nodes"), F.count_if("active").alias("online_nodes"))
    since = messages.filter((F.col("ts_us") >= started_us) & (F.col("ts_us") <= now_us)).agg(F.count("*").alias("messages"))
    return counted.crossJoin(since).withColumn("uptime", uptime(F.floor((now_us - started_us) / 1_000_000)))  # one row each


def neighbor_edges(nodes: DataFrame) -> DataFrame:
    """(src, dst, snr): the neighbours that each node's newest report lists."""
    return nodes.select(F.col("id").alias("src"), F.inline("neighborinfo.neighbors")).select("src", hex_id(F.col("node_id")).alias("dst"), "snr")


def neighbor_records(nodes: DataFrame) -> DataFrame:
    """(src, dst, snr, km): distance where both ends have a place."""
    place = position_record(F.col("position"))
    a = nodes.select(F.col("id").alias("src"), place.alias("a"))
    b = nodes.select(F.col("id").alias("dst"), place.alias("b"))
    km = distance_km(F.col("a.latitude"), F.col("a.longitude"), F.col("b.latitude"), F.col("b.longitude"))
    return neighbor_edges(nodes).join(a, "src").join(b, "dst", "left").select("src", "dst", "snr", km.alias("km"))


def found_node(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each ``wanted(said)`` the node of that id, or else the first with that short name, whatever its case."""
    key = lambda by, value: F.struct(F.lit(by).alias("by"), value.alias("key"))
    # both look-ups are one join, so the nodes are computed once
    keys = nodes.select("id", F.inline(F.array(key("id", F.col("id")), key("name", F.lower("shortname")))))
    bare = F.lower(F.trim("said"))
    said = wanted.select("said").distinct().select("said", F.inline(F.array(key("id", F.regexp_replace(bare, "!", "")), key("name", bare))))
    found = keys.join(said, ["by", "key"]).groupBy("said").agg(F.min(F.when(F.col("by") == "id", F.col("id"))).alias("__id"), F.min(F.when(F.col("by") == "name", F.col("id"))).alias("__named"))
    return wanted.join(found, "said", "left").select("said", F.coalesce("__id", "__named").alias("id"))


def resolved_routes(traces: DataFrame, nodes: DataFrame) -> DataFrame:
    """``traces(seq, route, ...)`` with ``route_ids``: the id of the first node with a hop's long name, else the hop as it is."""
    names = nodes.groupBy("longname").agg(F.min("id").alias("hop_id"))
    hops = traces.select("seq", F.posexplode("route").alias("at", "hop")).join(names, F.col("hop") == F.col("longname"), "left")
    ids = F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("hop_id", "hop").alias("id")))), lambda x: x["id"])
    return traces.join(hops.groupBy("seq").agg(ids.alias("route_ids")), "seq", "left").withColumn("route_ids", F.coalesce("route_ids", F.array().cast("array<string>")))


SORT_KEYS = ("altitude", "shortname", "longname", "last_us")


def sorted_nodes(records: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """Records in the order of a key, then of their ids; unknown altitudes, and altitude zero, count as -1."""
    if key not in SORT_KEYS:
        raise ValueError(f"nodes are sorted by one of {SORT_KEYS}")
    by = F.when(F.coalesce("position.altitude", F.lit(0)) == 0, -1).otherwise(F.col("position.altitude")) if key == "altitude" else F.col(key)
    return records.orderBy(by.desc_nulls_last() if descending else by.asc_nulls_first(), "id")
