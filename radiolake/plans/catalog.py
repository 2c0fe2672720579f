"""Registered queries over the driver's tables, each with the same query in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from radiolake.functions import mesh as m
from radiolake.operators import graph, state
from radiolake.plans.registry import ORACLE_SQL, query
from radiolake.sources import decode, model, snapshot

NOW_US = f"epoch_us(TIMESTAMP '{model.NOW}')"
NODES = """nodes AS (SELECT printf('%08x', c_custkey) AS id, c_custkey AS num, c_name AS longname, right(c_name, 4) AS shortname,
  CAST(c_nationkey % 11 AS INTEGER) AS role, c_nationkey AS hardware, c_custkey * 7919 * 1009 % 1800000000 - 900000000 AS lat_i,
  c_custkey * 104729 * 31 % 3600000000 - 1800000000 AS lon_i FROM customer)"""
LOG = """log AS (SELECT event_id AS seq, printf('%08x', user_id) AS from_id, user_id AS from_num, epoch_us(ts) AS ts_us, event_type AS kind, value, props,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""
EDGES = f"{LOG}, edges AS (SELECT from_num AS src, k AS dst, arg_max(value, seq) AS snr FROM log WHERE k IS NOT NULL GROUP BY 1, 2)"
FOLD = f"{LOG}, state AS (SELECT from_num, max(ts_us) AS last_us, max(seq) AS last_seq, count(*) AS packets FROM log GROUP BY 1)"
CHAT = "chat AS (SELECT CAST(conv_id AS VARCHAR) AS channel, turn AS id, role AS sender, text, conv_id AS from_num FROM conversations)"
ROUTES = """routes AS (SELECT o_orderkey AS seq, o_custkey AS from_num, hops FROM orders JOIN (SELECT l_orderkey,
  list(l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS hops FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def km_sql(a: str, b: str, c: str, d: str) -> str:
    return f"round(2 * asin(sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))) * {m.EARTH_KM}, 2)"


def states(spark: SparkSession, sf: str) -> DataFrame:
    return state.current(state.fold(model.events(spark, sf)))


def nodes_with_state(spark: SparkSession, sf: str) -> DataFrame:
    s = states(spark, sf).withColumnRenamed("from_num", "num")
    return model.nodes(spark, sf).join(s, "num", "left").withColumn("active", state.is_active(F.col("last_us"), model.now_us()))


LIVE = f"{NODES}, {FOLD}, live AS (SELECT n.*, s.* EXCLUDE (from_num), coalesce(({NOW_US} - last_us) // 1000000 < {state.INACTIVE_S}, false) AS active FROM nodes n LEFT JOIN state s ON n.num = s.from_num)"


@query(f"WITH {LIVE}, host AS (SELECT lat_i / 1e7 AS hlat, lon_i / 1e7 AS hlon FROM nodes WHERE num = 0) SELECT id, shortname, longname, role, hardware, last_us, {km_sql('hlat', 'hlon', 'lat_i / 1e7', 'lon_i / 1e7')} AS dx_km FROM live, host WHERE active")
def nodes_active(spark, sf):
    """Active nodes with their distance from the host node."""
    host = model.nodes(spark, sf).filter("num = 0").limit(1).select(m.degrees_of(F.col("lat_i")).alias("hlat"), m.degrees_of(F.col("lon_i")).alias("hlon"))
    rows = nodes_with_state(spark, sf).filter("active").crossJoin(F.broadcast(host))  # one row
    dx = m.distance_km(F.col("hlat"), F.col("hlon"), m.degrees_of(F.col("lat_i")), m.degrees_of(F.col("lon_i")))
    return rows.select("id", "shortname", "longname", "role", "hardware", "last_us", dx.alias("dx_km"))


@query(f"WITH {LIVE} SELECT id, last_us, active FROM live WHERE ({NOW_US} - last_us) // 86400000000 <= 7")
def nodes_recent_days(spark, sf):
    return nodes_with_state(spark, sf).filter(state.recent(F.col("last_us"), model.now_us(), 7)).select("id", "last_us", "active")


@query(f"WITH {NODES} SELECT id, longname FROM nodes WHERE id IN ('00000003', '0000000b', '0000004d')")
def nodes_by_ids(spark, sf):
    """Ids given as decimal, hex with a mark, and eight hex digits."""
    wanted = spark.createDataFrame([("3",), ("!0000000b",), ("0000004d",)], "raw string").select(m.parse_id(F.col("raw")).alias("id"))
    return model.nodes(spark, sf).join(wanted, "id", "left_semi").select("id", "longname")


@query(f"WITH {NODES} SELECT id, longname, shortname FROM nodes WHERE contains(lower(longname), lower('R#00000')) AND contains(lower(shortname), '1')")
def nodes_name_contains(spark, sf):
    n = model.nodes(spark, sf)
    return n.filter(F.contains(F.lower("longname"), F.lower(F.trim(F.lit(" R#00000 ")))) & F.contains(F.lower("shortname"), F.lit("1"))).select("id", "longname", "shortname")


@query(f"WITH {LIVE} SELECT id, longname, last_us FROM live WHERE NOT coalesce((epoch_us(TIMESTAMP '{model.LATER}') - last_us) // 1000000 < 7200, false) AND last_us IS NOT NULL")
def nodes_offline(spark, sf):
    """Nodes not heard for two hours, some time after the log's end."""
    later = F.unix_micros(F.lit(model.LATER).cast("timestamp"))
    n = nodes_with_state(spark, sf).withColumn("active", state.is_active(F.col("last_us"), later, 7200))
    return n.filter(~F.col("active") & F.col("last_us").isNotNull()).select("id", "longname", "last_us")


@query(f"WITH {NODES} SELECT id, num, longname, role FROM nodes WHERE id = '00000011'")
def node_lookup(spark, sf):
    return model.nodes(spark, sf).filter(F.col("id") == "00000011").select("id", "num", "longname", "role")


@query(f"WITH {NODES}, f AS (SELECT *, row_number() OVER (PARTITION BY shortname ORDER BY num) AS r FROM nodes) SELECT shortname, id, longname FROM f WHERE r = 1")
def first_by_shortname(spark, sf):
    return state.first_by_name(model.nodes(spark, sf), "shortname", "num").select("shortname", "id", "longname")


@query("SELECT c_custkey AS node_id, n_name AS area, o_orderkey AS position_id, o_totalprice AS altitude FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE r = 1")
def latest_per_node(spark, sf):
    """Current nodes: the newest row of each, with two inner joins."""
    newest = state.latest(model.table(spark, sf, "orders"), "o_custkey", F.desc("o_orderdate"), F.desc("o_orderkey"))
    c, n = model.table(spark, sf, "customer"), model.table(spark, sf, "nation")
    out = newest.join(c, newest["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return out.select(F.col("c_custkey").alias("node_id"), F.col("n_name").alias("area"), F.col("o_orderkey").alias("position_id"), F.col("o_totalprice").alias("altitude"))


@query(f"WITH {LOG} SELECT seq, from_id, ts_us - lag(ts_us) OVER (PARTITION BY from_num ORDER BY ts_us, seq) AS since_us FROM log")
def since_previous(spark, sf):
    return state.since_previous(model.events(spark, sf)).select("seq", "from_id", "since_us")


LATER_US = f"epoch_us(TIMESTAMP '{model.LATER}')"


@query(f"WITH {FOLD} SELECT from_num, (({LATER_US} - last_us) % 86400000000 + 86400000000) % 86400000000 // 1000000 AS age_s, ({LATER_US} - last_us) // 1000000 AS total_s FROM state")
def age_within_day(spark, sf):
    """Seconds since a node was heard, in all and beyond whole days."""
    age = F.unix_micros(F.lit(model.LATER).cast("timestamp")) - F.col("last_us")
    return states(spark, sf).select("from_num", m.seconds_within_day(age).alias("age_s"), F.floor(age / 1_000_000).alias("total_s"))


@query(f"WITH {LOG} SELECT seq, from_id, value FROM log WHERE kind IN ('view', 'click') ORDER BY seq DESC LIMIT 1000")
def telemetry_latest_1000(spark, sf):
    return model.events(spark, sf).filter(F.col("kind").isin(*state.TELEMETRY)).orderBy(F.desc("seq")).limit(1000).select("seq", "from_id", "value")


@query(f"WITH {LOG} SELECT seq, from_id, kind FROM log ORDER BY seq LIMIT 1000")
def messages_oldest_1000(spark, sf):
    return model.events(spark, sf).orderBy("seq").limit(1000).select("seq", "from_id", "kind")


@query(f"WITH {NODES}, {LOG} SELECT seq, coalesce(shortname, 'UNK') AS shortname, round(value, 1) AS value FROM log LEFT JOIN (SELECT * FROM nodes WHERE role <> 3) n ON n.num = from_num WHERE kind IN ('view', 'click')")
def telemetry_with_names(spark, sf):
    n = model.nodes(spark, sf).filter("role <> 3").select(F.col("num").alias("from_num"), "shortname")
    t = model.events(spark, sf).filter(F.col("kind").isin(*state.TELEMETRY)).join(n, "from_num", "left")
    return t.select("seq", F.coalesce("shortname", F.lit("UNK")).alias("shortname"), F.round("value", 1).alias("value"))


@query(f"WITH {LOG} SELECT seq, value FROM log WHERE kind IN ('view', 'click') AND from_id = '00000005'")
def telemetry_for_node(spark, sf):
    return model.events(spark, sf).filter(F.col("kind").isin(*state.TELEMETRY) & (F.col("from_id") == "00000005")).select("seq", "value")


@query(f"""WITH {NODES}, {CHAT}, c AS (SELECT channel, chat.id, from_num, from_num + chat.id AS to_num, from_num * 2 + 1 AS via_num FROM chat)
SELECT channel, c.id, coalesce(f.shortname, 'UNK') AS from_name, coalesce(t.shortname, 'ALL') AS to_name, v.shortname AS via_name,
  {km_sql('f.lat_i / 1e7', 'f.lon_i / 1e7', 'v.lat_i / 1e7', 'v.lon_i / 1e7')} AS dx_km
FROM c LEFT JOIN nodes f ON f.num = from_num LEFT JOIN nodes t ON t.num = to_num LEFT JOIN nodes v ON v.num = via_num""")
def chat_three_way(spark, sf):
    n = model.nodes(spark, sf)
    c = model.chat(spark, sf).withColumns({"to_num": F.col("from_num") + F.col("id"), "via_num": F.col("from_num") * 2 + 1})
    for side in ("from", "to", "via"):
        c = c.join(n.select(F.col("num").alias(f"{side}_num"), F.col("shortname").alias(f"{side}_short"), m.degrees_of(F.col("lat_i")).alias(f"{side}_lat"), m.degrees_of(F.col("lon_i")).alias(f"{side}_lon")), f"{side}_num", "left")
    dx = m.distance_km(F.col("from_lat"), F.col("from_lon"), F.col("via_lat"), F.col("via_lon"))
    return c.select("channel", "id", F.coalesce("from_short", F.lit("UNK")).alias("from_name"), F.coalesce("to_short", F.lit("ALL")).alias("to_name"), F.col("via_short").alias("via_name"), dx.alias("dx_km"))


@query(f"WITH {CHAT} SELECT channel, id, string_agg(DISTINCT sender, ',' ORDER BY sender) AS senders, first(text ORDER BY sender NULLS FIRST, text NULLS FIRST) AS text FROM chat GROUP BY channel, id")
def chat_dedupe(spark, sf):
    """Copies of a message within a channel as one row: the first copy's text, every sender once."""
    first = F.min(F.struct(F.col("sender"), F.col("text")))["text"]
    return model.chat(spark, sf).groupBy("channel", "id").agg(F.array_join(F.sort_array(F.collect_set("sender")), ",").alias("senders"), first.alias("text"))


@query(f"""WITH {CHAT} SELECT channel, id, string_agg(sender, ',' ORDER BY sender NULLS FIRST, text NULLS FIRST) AS senders, last(text ORDER BY sender NULLS FIRST, text NULLS FIRST) AS text, count(*) AS copies
FROM chat GROUP BY channel, id""")
def chat_dedupe_all(spark, sf):
    """Copies of a message within a channel as one row: the last copy's text, all senders.

    The tables have no order of arrival within a channel, so copies are ordered by sender and text.
    """
    copies = model.chat(spark, sf).groupBy("channel", "id").agg(F.sort_array(F.collect_list(F.struct("sender", "text"))).alias("c"))
    return copies.select("channel", "id", F.array_join(F.transform("c", lambda x: x["sender"]), ",").alias("senders"), F.element_at("c", -1)["text"].alias("text"), F.size("c").cast("long").alias("copies"))


@query(f"WITH {CHAT} SELECT channel, CASE WHEN channel = '0' THEN 'General' ELSE 'Channel ' || channel END AS name, count(*) AS messages FROM chat GROUP BY 1, 2")
def channel_counts(spark, sf):
    name = F.when(F.col("channel") == "0", "General").otherwise(F.concat(F.lit("Channel "), "channel"))
    return model.chat(spark, sf).groupBy("channel", name.alias("name")).agg(F.count("*").alias("messages"))


@query(f"WITH {CHAT} SELECT channel, id, sender, text FROM chat WHERE from_num = 4 OR from_num + id = 4")
def texts_for_node(spark, sf):
    return model.chat(spark, sf).filter((F.col("from_num") == 4) | (F.col("from_num") + F.col("id") == 4)).select("channel", "id", "sender", "text")


def in_channels(chat: DataFrame, *channels: str) -> DataFrame:
    """Messages of the displayed channels."""
    return chat.filter(F.col("channel").isin(*channels))


SHOWN = [str(c) for c in range(0, 200, 2)]


@query(f"WITH {CHAT} SELECT channel, id FROM chat WHERE contains(text, 'the') AND contains(text, 'and') AND contains(text, 'er') AND channel IN ({', '.join(f"'{c}'" for c in SHOWN)})")
def marker_in_channels(spark, sf):
    """Three markers in one text, in displayed channels."""
    return in_channels(model.chat(spark, sf).filter(m.has_markers(F.col("text"), "the", "and", "er")), *SHOWN).select("channel", "id")


@query(f"WITH {NODES}, {ROUTES}, h AS (SELECT seq, from_num, unnest(hops) AS hop, generate_subscripts(hops, 1) AS i FROM routes) SELECT seq, coalesce(any_value(f.shortname), 'UNK') AS from_name, string_agg(coalesce(n.shortname, 'UNK'), '>' ORDER BY i) AS path, count(*) AS hops FROM h LEFT JOIN (SELECT * FROM nodes WHERE role <> 5) n ON n.num = hop LEFT JOIN nodes f ON f.num = h.from_num GROUP BY seq")
def traceroute_hops(spark, sf):
    n = model.nodes(spark, sf)
    hop = n.filter("role <> 5").select(F.col("num").alias("hop"), F.col("shortname").alias("name"))
    paths = model.hops(spark, sf).join(hop, "hop", "left").groupBy("seq").agg(model.in_order(F.coalesce("name", F.lit("UNK"))).alias("names"))
    heads = model.heads(spark, sf).join(n.select(F.col("num").alias("from_num"), F.col("shortname").alias("from_name")), "from_num", "left")
    return heads.join(paths, "seq").select("seq", F.coalesce("from_name", F.lit("UNK")).alias("from_name"), F.array_join("names", ">").alias("path"), F.size("names").cast("long").alias("hops"))


@query(f"WITH {NODES}, {ROUTES}, h AS (SELECT seq, unnest(hops) AS hop, generate_subscripts(hops, 1) AS i FROM routes) SELECT seq, string_agg(coalesce(id, CAST(hop AS VARCHAR)), ',' ORDER BY i) AS route_ids FROM h LEFT JOIN (SELECT * FROM nodes WHERE role <> 5) n ON num = hop GROUP BY seq")
def traceroute_resolution(spark, sf):
    """Hops as ids of known nodes, the raw value of others."""
    known = model.nodes(spark, sf).filter("role <> 5").select(F.col("num").alias("hop"), "id")
    hops = model.hops(spark, sf).join(known, "hop", "left").withColumn("id", F.coalesce("id", F.col("hop").cast("string")))
    routed = hops.groupBy("seq").agg(model.in_order(F.col("id")).alias("ids"))
    return model.heads(spark, sf).join(routed, "seq").select("seq", F.array_join("ids", ",").alias("route_ids"))


@query(f"WITH {ROUTES} SELECT seq, len(hops) AS n_hops FROM routes WHERE from_num = 7 OR list_contains(hops, 7)")
def traceroutes_for_node(spark, sf):
    return model.routes(spark, sf).filter((F.col("from_num") == 7) | F.array_contains("hops", 7)).select("seq", F.size("hops").cast("long").alias("n_hops"))


@query(f"WITH {NODES}, {EDGES} SELECT src, dst, snr, coalesce(shortname, 'UNK') AS shortname FROM edges LEFT JOIN (SELECT * FROM nodes WHERE role <> 3) ON num = dst")
def neighbors_heard(spark, sf):
    return graph.with_names(model.edges(spark, sf), model.nodes(spark, sf).filter("role <> 3")).select("src", "dst", "snr", "shortname")


@query(f"WITH {NODES}, {EDGES} SELECT src, dst, snr, shortname FROM edges JOIN (SELECT * FROM nodes WHERE role <> 3) ON num = dst")
def neighbors_heard_known(spark, sf):
    return graph.with_names(model.edges(spark, sf), model.nodes(spark, sf).filter("role <> 3"), "inner").select("src", "dst", "snr", "shortname")


@query(f"WITH {NODES}, {EDGES} SELECT dst AS node, src AS heard_by, snr, coalesce(shortname, 'UNK') AS shortname FROM edges LEFT JOIN nodes ON num = src")
def neighbors_heard_by(spark, sf):
    back = graph.with_names(graph.reversed_edges(model.edges(spark, sf)), model.nodes(spark, sf))
    return back.select(F.col("src").alias("node"), F.col("dst").alias("heard_by"), "snr", "shortname")


@query(f"WITH {EDGES} SELECT a.src, a.dst, a.snr FROM edges a SEMI JOIN edges b ON a.src = b.dst AND a.dst = b.src")
def reciprocal_edges(spark, sf):
    return graph.reciprocal(model.edges(spark, sf)).select("src", "dst", "snr")


@query(f"WITH {EDGES}, u AS (SELECT src AS a, dst AS b, 1 AS heard, 0 AS heard_by FROM edges UNION ALL SELECT dst, src, 0, 1 FROM edges) SELECT a, b, CASE WHEN max(heard) + max(heard_by) = 2 THEN 'both' WHEN max(heard) = 1 THEN 'heard' ELSE 'heard by' END AS class FROM u GROUP BY 1, 2")
def edge_classes(spark, sf):
    return graph.classes(model.edges(spark, sf))


PLACED = "p AS (SELECT num, lat_i / 1e7 AS lat, lon_i / 1e7 AS lon FROM nodes WHERE coalesce(lat_i, 0) <> 0 AND coalesce(lon_i, 0) <> 0)"


@query(f"WITH {NODES}, {EDGES}, {PLACED} SELECT src, dst, {km_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS km FROM edges JOIN p a ON a.num = src JOIN p b ON b.num = dst")
def edge_distance(spark, sf):
    return graph.segments(model.edges(spark, sf), model.nodes(spark, sf)).select("src", "dst", "km")


@query(f"WITH {NODES}, {EDGES}, {PLACED} SELECT src, dst, a.lat AS src_lat, a.lon AS src_lon, b.lat AS dst_lat, b.lon AS dst_lon, round(sqrt(pow(b.lon - a.lon, 2) + pow(b.lat - a.lat, 2)) * 111.32, 2) AS planar_km FROM edges JOIN p a ON a.num = src JOIN p b ON b.num = dst")
def map_segments(spark, sf):
    s = graph.segments(model.edges(spark, sf), model.nodes(spark, sf))
    planar = m.planar_km(F.col("src_lat"), F.col("src_lon"), F.col("dst_lat"), F.col("dst_lon"))
    return s.select("src", "dst", "src_lat", "src_lon", "dst_lat", "dst_lon", planar.alias("planar_km"))


@query(f"WITH {NODES} SELECT id, round(radians(lon_i / 1e7) * 6378137, 1) AS x, round(ln(nullif(tan(pi() / 4 + radians(lat_i / 1e7) / 2), 0)) * 6378137, 1) AS y FROM nodes")
def mercator(spark, sf):
    return model.nodes(spark, sf).select("id", F.round(m.mercator_x(m.degrees_of(F.col("lon_i"))), 1).alias("x"), F.round(m.mercator_y(m.degrees_of(F.col("lat_i"))), 1).alias("y"))


ROLE_VALUES = ", ".join(f"({r}, '{t}', '{a}')" for r, t, a in model.ROLES)


@query(f"WITH {NODES}, roles(role, title, abbreviation) AS (VALUES {ROLE_VALUES}) SELECT id, title, abbreviation FROM nodes LEFT JOIN roles USING (role)")
def role_dim(spark, sf):
    return model.nodes(spark, sf).join(F.broadcast(model.roles(spark)), "role", "left").select("id", "title", "abbreviation")


@query("SELECT c_custkey AS num, printf('%08x', c_custkey + 4294967290) AS hex, c_custkey + 4294967290 AS back FROM customer")
def hex_roundtrip(spark, sf):
    h = m.hex_id(F.col("c_custkey") + 4294967290)
    return model.table(spark, sf, "customer").select(F.col("c_custkey").alias("num"), h.alias("hex"), m.int_id(h).alias("back"))


@query(f"WITH {LIVE}, {CHAT} SELECT (SELECT count(*) FROM live WHERE active) AS active_nodes, (SELECT count(*) FROM chat WHERE channel = '0') AS total_chat, (SELECT count(*) FROM live) AS total_nodes, (SELECT count(*) FROM log) AS total_messages, (SELECT count(*) FROM log) AS total_mqtt_messages, (SELECT count(*) FROM log WHERE kind IN ('view', 'click')) AS total_telemetry, (SELECT count(*) FROM orders) AS total_traceroutes")
def stats(spark, sf):
    """Mesh-wide counters as one row; the log is scanned once, the cross joins are of one-row aggregates."""
    e = model.events(spark, sf)
    senders = e.groupBy("from_num").agg(F.max("ts_us").alias("last_us"), F.count("*").alias("packets"), F.count_if(F.col("kind").isin(*state.TELEMETRY)).alias("reports"))
    both = senders.join(model.nodes(spark, sf).select(F.col("num").alias("from_num"), F.lit(1).alias("node")), "from_num", "full")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    live = both.agg(F.count_if(F.col("node").isNotNull() & state.is_active(F.col("last_us"), model.now_us())).alias("active_nodes"), F.count("node").alias("total_nodes"), total("packets").alias("total_messages"), total("packets").alias("total_mqtt_messages"), total("reports").alias("total_telemetry"))
    chat = model.chat(spark, sf).agg(F.count_if(F.col("channel") == "0").alias("total_chat"))
    trace = model.table(spark, sf, "orders").agg(F.count("*").alias("total_traceroutes"))
    return live.crossJoin(chat).crossJoin(trace).select("active_nodes", "total_chat", "total_nodes", "total_messages", "total_mqtt_messages", "total_telemetry", "total_traceroutes")


@query(f"WITH {NODES} SELECT id FROM (SELECT id, CASE WHEN num % 7 = 0 THEN 'UNK' ELSE shortname END AS s, CASE WHEN num % 5 = 0 THEN NULL ELSE longname END AS l FROM nodes) WHERE s IS NULL OR l IS NULL OR s = 'UNK' OR l = 'Unknown'")
def needs_enrichment(spark, sf):
    n = model.nodes(spark, sf).withColumns({"s": F.when(F.col("num") % 7 == 0, "UNK").otherwise(F.col("shortname")), "l": F.when(F.col("num") % 5 != 0, F.col("longname"))})
    return n.filter(state.needs_enrichment(F.col("s"), F.col("l"))).select("id")


@query(f"WITH {NODES} SELECT n.id, coalesce('S' || s_suppkey, shortname) AS shortname, coalesce(s_name, longname) AS longname FROM nodes n LEFT JOIN supplier ON s_suppkey = num")
def enrichment_merge(spark, sf):
    s = model.table(spark, sf, "supplier").select(m.hex_id(F.col("s_suppkey")).alias("id"), F.concat(F.lit("S"), "s_suppkey").alias("shortname"), F.col("s_name").alias("longname"))
    return state.enriched(model.nodes(spark, sf), s, ["shortname", "longname"]).select("id", "shortname", "longname")


@query(f"WITH {NODES} SELECT id, CASE WHEN s_suppkey IS NOT NULL THEN s_nationkey ELSE lat_i END AS lat_i FROM nodes LEFT JOIN supplier ON s_suppkey = num")
def override_overlay(spark, sf):
    o = model.table(spark, sf, "supplier").select(m.hex_id(F.col("s_suppkey")).alias("id"), F.col("s_nationkey").cast("long").alias("lat_i"))
    return state.overlaid(model.nodes(spark, sf), o, ["lat_i"]).select("id", "lat_i")


@query(f"WITH {NODES} SELECT id, longname FROM nodes UNION ALL SELECT * FROM (VALUES ('ffffffff', 'Everyone'), ('00000001', 'Host')) v WHERE col0 NOT IN (SELECT id FROM nodes)")
def seed_union(spark, sf):
    seeds = spark.createDataFrame([(model.EVERYONE, "Everyone"), ("00000001", "Host")], "id string, longname string")
    return state.seeded(model.nodes(spark, sf).select("id", "longname"), seeds)


def reach_sql(start: int) -> str:
    return f"WITH RECURSIVE {EDGES}, r AS (SELECT CAST({start} AS BIGINT) AS node, 0 AS level UNION SELECT e.dst, r.level + 1 FROM r JOIN edges e ON e.src = r.node WHERE r.level < 10) SELECT node, CAST(min(level) AS INTEGER) AS level FROM r GROUP BY node"


@query(reach_sql(0))
def graph_reach(spark, sf):
    """Nodes within ten hops of node 0 over all edges, with the least number of hops."""
    snapshot.use_checkpoints(spark)
    return graph.reach(model.edges(spark, sf).select("src", "dst").checkpoint(), 0)


@query(reach_sql(7))
def graph_reach_all(spark, sf):
    """The same from node 7."""
    snapshot.use_checkpoints(spark)
    return graph.reach(model.edges(spark, sf).select("src", "dst").checkpoint(), 7)


@query(f"WITH {LOG} SELECT seq, from_id, ts_us, kind FROM log")
def log_clean(spark, sf):
    """The log without what only decoding needs."""
    log = model.events(spark, sf).withColumnsRenamed({"props": "decoded", "value": "encrypted"})
    return decode.clean_log(log).drop("k", "from_num")


@query("SELECT event_id AS seq, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_decode(spark, sf):
    e = model.table(spark, sf, "events")
    return e.select(F.col("event_id").alias("seq"), F.from_json("props", "k int")["k"].alias("k"))


@query(f"WITH {LOG} SELECT kind, count(*) AS packets, count(DISTINCT from_num) AS senders, CASE kind WHEN 'view' THEN 'telemetry' WHEN 'click' THEN 'telemetry' WHEN 'signup' THEN 'nodeinfo' WHEN 'purchase' THEN 'position' ELSE 'unknown' END AS label FROM log GROUP BY kind")
def kind_fanout(spark, sf):
    kind = F.col("kind")
    label = F.when(kind.isin("view", "click"), "telemetry").when(kind == "signup", "nodeinfo").when(kind == "purchase", "position").otherwise("unknown")
    return model.events(spark, sf).groupBy("kind").agg(F.count("*").alias("packets"), F.count_distinct("from_num").alias("senders")).withColumn("label", label)


@query(f"WITH {EDGES} SELECT src, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE snr > 50) AS BIGINT) AS strong, string_agg(printf('%08x', dst), ',' ORDER BY dst) AS ids, bool_or(dst = src) AS hears_itself FROM edges GROUP BY src")
def array_ops(spark, sf):
    near = model.edges(spark, sf).groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dst", "snr"))).alias("near"))
    ids = F.array_join(F.transform("near", lambda x: m.hex_id(x["dst"])), ",")
    return near.select("src", F.size("near").cast("long").alias("n"), F.size(F.filter("near", lambda x: x["snr"] > 50)).cast("long").alias("strong"), ids.alias("ids"), F.exists("near", lambda x: x["dst"] == F.col("src")).alias("hears_itself"))


@query(f"WITH {LIVE} SELECT id, lat_i / 1e7 AS lat, lon_i / 1e7 AS lon, coalesce(last_us > {NOW_US} - 7200000000, false) AS online FROM live WHERE coalesce(lat_i, 0) <> 0 AND coalesce(lon_i, 0) <> 0")
def online_window(spark, sf):
    """Map points: nodes with a position, online if heard in the last two hours."""
    n = nodes_with_state(spark, sf).filter(m.has_position(F.col("lat_i"), F.col("lon_i")))
    return n.select("id", m.degrees_of(F.col("lat_i")).alias("lat"), m.degrees_of(F.col("lon_i")).alias("lon"), F.coalesce(F.col("last_us") > model.now_us() - 7_200_000_000, F.lit(False)).alias("online"))


@query(f"WITH {FOLD} SELECT from_num, coalesce(({NOW_US} - last_us) // 1000000 < 86400, false) AS active, coalesce((({NOW_US} - last_us) % 86400000000 + 86400000000) % 86400000000 // 1000000 < 7200, false) AS active_within_day FROM state")
def expire(spark, sf):
    s, now = states(spark, sf), model.now_us()
    return s.select("from_num", state.is_active(F.col("last_us"), now).alias("active"), state.is_active(F.col("last_us"), now, 7200, within_day=True).alias("active_within_day"))


@query(f"WITH {LIVE}, s AS (SELECT * FROM live WHERE active ORDER BY shortname, num LIMIT 100) SELECT id, shortname, row_number() OVER (ORDER BY shortname, num) AS rank FROM s")
def nodes_sorted(spark, sf):
    """The first hundred active nodes by short name; only these are numbered in one task."""
    first = nodes_with_state(spark, sf).filter("active").orderBy("shortname", "num").limit(100)
    return first.select("id", "shortname", F.row_number().over(Window.orderBy("shortname", "num")).cast("long").alias("rank"))


@query(f"WITH {FOLD} SELECT from_num, CAST(last_us // 1000000 // 86400 AS VARCHAR) || 'd ' || CAST(last_us // 1000000 // 3600 AS VARCHAR) || 'h ' || CAST(last_us // 1000000 // 60 AS VARCHAR) || 'm ' || CAST(last_us // 1000000 % 60 AS VARCHAR) || 's' AS uptime, strftime(make_timestamp(last_us // 1000000 * 1000000), '%Y-%m-%d %H:%M:%S') || ' +0000' AS seen FROM state")
def uptime_text(spark, sf):
    seconds = F.floor(F.col("last_us") / 1_000_000)
    return states(spark, sf).select("from_num", m.uptime(seconds).alias("uptime"), m.local_time(seconds).alias("seen"))


@query("SELECT s_suppkey, coalesce(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(s_suppkey % 120 AS INTEGER)) < TIMESTAMP '2024-01-01 01:00:00', true) AS due FROM supplier")
def geocode_due(spark, sf):
    last = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("s_suppkey") % 120).cast("int"))
    return model.table(spark, sf, "supplier").select("s_suppkey", m.asks_for_refresh(last, F.lit("2024-01-01 02:00:00").cast("timestamp")).alias("due"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: w[1]), '') AS initials, len(replace(p_brand, '!', '')) = 8 AS valid_id FROM part")
def text_helpers(spark, sf):
    return model.table(spark, sf, "part").select("p_partkey", m.initials(F.col("p_name")).alias("initials"), m.valid_id(F.col("p_brand")).alias("valid_id"))


@query(f"WITH {FOLD}, t AS (SELECT from_num, arg_max(value, seq) FILTER (WHERE kind IN ('view', 'click')) AS telemetry, arg_max(k, seq) FILTER (WHERE kind = 'signup') AS info FROM log GROUP BY 1) SELECT from_num, last_us, last_seq, packets, telemetry, info FROM state JOIN t USING (from_num)")
def state_fold(spark, sf):
    return states(spark, sf)


@query(ORACLE_SQL["state_fold"])
def stream_fold(spark, sf):
    """The same state, folded by a stream over the log in micro-batches."""
    from radiolake.streaming.fold import fold_stream, latest

    base = f"{snapshot.shared_dir(spark)}/radiolake/stream-{spark.sparkContext.applicationId}-{spark.sql('select uuid()').first()[0]}"
    model.events(spark, sf).repartitionByRange(3, "seq").write.parquet(f"{base}/log")
    log = spark.readStream.schema(model.events(spark, sf).schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/log")
    fold_stream(log, f"{base}/state", f"{base}/offsets").awaitTermination()
    return state.current(latest(spark, f"{base}/state", "from_num"))
