"""The node fold against a replay in plain Python, its stream, and snapshots."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from radiolake.operators import nodes
from radiolake.plans import packets, registry  # noqa: F401
from radiolake.sources import decode, model, snapshot
from radiolake.streaming import fold

SF = "/root/testdata/sf0.001"
NOW = 1_000_000_000


def random_packets(n, seed):
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        kind = rng.choice(["nodeinfo", "position", "telemetry", "neighborinfo", "text", "traceroute", "routing"])
        packet = {"from": rng.randrange(6), "type": kind}
        maybe = lambda v: v if rng.random() < 0.6 else None
        payload = {
            "nodeinfo": {"id": rng.choice([f"!{packet['from']:08x}", f"{rng.randrange(6):08x}", "short", None]), "hardware": maybe(seq), "hw_model": maybe(seq + 1), "longname": maybe(f"L{seq}"), "long_name": maybe(f"l{seq}"), "shortname": maybe(f"S{seq}"), "short_name": maybe(f"s{seq}"), "role": maybe(seq % 11)},
            "position": maybe({"latitude_i": seq, "longitude_i": -seq, "altitude": seq}), "telemetry": maybe({"battery_level": seq}), "neighborinfo": {"neighbors": [{"node_id": rng.randrange(9), "snr": 1.5}]},
            "text": {"text": rng.choice(["TC BBS Commands", "TC BBS", "hi"])}, "traceroute": {"route": ["a"]}, "routing": {},
        }[kind]
        if payload is not None:
            packet["payload"] = payload
        out.append((seq, seq * 1000, "msh/XX/2/json/x", json.dumps({k: v for k, v in packet.items() if v is not None})))
    return out


def replay(messages):
    """Packet by packet, as a store in memory would."""
    known = {}
    for seq, ts, _, body in messages:
        p = json.loads(body)
        kind, payload, own = p["type"], p.get("payload"), f"{p['from']:08x}"
        if kind in ("traceroute", "routing"):
            continue
        if kind == "text":
            if own in known:
                known[own]["last_us"] = ts
                known[own]["board"] |= all(x in payload["text"] for x in ("TC", "BBS", "Commands"))
            continue
        if kind == "nodeinfo":
            own = (payload["id"] or "").replace("!", "")
            if len(own) != 8:
                continue
        node = known.setdefault(own, {"longname": "Unknown", "shortname": "UNK", "hardware": None, "role": None, "position": None, "telemetry": None, "neighborinfo": None, "board": False})
        node["last_us"] = ts
        if kind == "nodeinfo":
            for field, names in (("hardware", ("hardware", "hw_model")), ("longname", ("longname", "long_name")), ("shortname", ("shortname", "short_name"))):
                node[field] = next((payload[x] for x in names if payload[x] is not None), node[field])
            node["role"] = payload["role"] or 0
        else:
            node[kind] = payload
    return known


def messages_of(spark, messages):
    return spark.createDataFrame(messages, "seq long, ts_us long, topic string, body string")


def packets_of(spark, messages):
    return model.packets(messages_of(spark, messages))


def as_dict(folded):
    out = {}
    for r in nodes.known_nodes(folded, F.lit(NOW)).collect():
        near = r["neighborinfo"] and {"neighbors": [{"node_id": x["node_id"], "snr": x["snr"]} for x in r["neighborinfo"]["neighbors"]]}
        at = r["position"] and {k: r["position"][k] for k in ("latitude_i", "longitude_i", "altitude")}
        out[r["id"]] = {**{k: r[k] for k in ("longname", "shortname", "hardware", "role", "board", "last_us")}, "position": at, "neighborinfo": near, "telemetry": r["telemetry"] and {k: int(v) for k, v in r["telemetry"].items()}}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_is_the_replay(spark, seed):
    messages = random_packets(150, seed)
    assert as_dict(nodes.fold_nodes(packets_of(spark, messages))) == replay(messages)
    parts = [nodes.fold_nodes(packets_of(spark, messages[i::3])) for i in range(3)]
    assert as_dict(nodes.merge_nodes(parts[2], nodes.merge_nodes(parts[1], parts[0]))) == replay(messages)
    log = messages_of(spark, messages)
    assert as_dict(nodes.fold_log(log)) == replay(messages)
    assert as_dict(nodes.merge_nodes(nodes.fold_log(log.filter("seq % 3 = 1")), nodes.fold_log(log.filter("seq % 3 <> 1")))) == replay(messages)
    assert nodes.fold_log(log.limit(0)).count() == 0
    plan = nodes.fold_log(log)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    twice = messages + messages[:40]
    assert as_dict(nodes.fold_nodes(packets_of(spark, twice))) == replay(messages)


def test_stream_is_the_batch(spark, tmp_path):
    messages = random_packets(120, 3)
    whole = spark.createDataFrame(messages, "seq long, ts_us long, topic string, body string")
    whole.repartitionByRange(4, "seq").write.parquet(f"{tmp_path}/m")
    stream = fold.read_log(spark, f"{tmp_path}/m", whole.schema, files_per_batch=1)
    fold.node_stream(model.packets(stream), f"{tmp_path}/changes", f"{tmp_path}/offsets").awaitTermination()
    assert as_dict(fold.latest_nodes(spark, f"{tmp_path}/changes")) == replay(messages)
    log = fold.read_log(spark, f"{tmp_path}/m", whole.schema)
    snapshot.append_log(log, f"{tmp_path}/log", f"{tmp_path}/log-offsets").awaitTermination()
    assert spark.read.schema(whole.schema).json(f"{tmp_path}/log").count() == 120


def test_no_packets_no_nodes(spark):
    folded = nodes.fold_nodes(packets_of(spark, random_packets(1, 1)).limit(0))
    assert nodes.known_nodes(folded, F.lit(NOW)).count() == 0 and nodes.merge_nodes(folded, folded).count() == 0
    assert nodes.default_nodes(spark.createDataFrame([("ffffffff",), ("00000001",)], "id string")).select("longname", "shortname").collect()[0][:] == ("Everyone", "ALL")


def test_filters_and_order(spark):
    messages = random_packets(150, 4)
    n = nodes.known_nodes(nodes.fold_nodes(packets_of(spark, messages)), F.lit(NOW))
    assert nodes.matching(n, F.lit(NOW)).count() == n.count()
    assert nodes.matching(n, F.lit(NOW), status="what").count() == n.count() and nodes.matching(n, F.lit(NOW), long_name=" % ").count() == 0
    heights = [(r["position"]["altitude"] or -1) for r in nodes.sorted_nodes(nodes.node_records(n), "altitude", descending=True).collect()]
    assert heights == sorted(heights, reverse=True)
    with pytest.raises(ValueError):
        nodes.sorted_nodes(nodes.node_records(n), "weight")


def test_snapshot_and_configuration(spark, tmp_path):
    table = spark.createDataFrame([("!0102030a", 5, "2024-01-01 00:00:00"), ("short", 6, None), (None, 7, None)], "id string, a int, t string").withColumn("t", F.col("t").cast("timestamp"))
    snapshot.save(table, f"{tmp_path}/s")
    snapshot.save(table, f"{tmp_path}/s")
    rows = snapshot.load(spark, f"{tmp_path}/s", table.schema).collect()
    assert [(r["id"], r["a"], str(r["t"])) for r in rows] == [("0102030a", 5, "2024-01-01 00:00:00")]
    config = {"broker": {"username": "u", "password": "p", "channels": [{"key": "k", "name": "n"}]}, "port": 1}
    assert snapshot.cleansed(config) == {"broker": {"channels": [{"name": "n"}]}, "port": 1} and config["broker"]["password"] == "p"
    assert json.loads(snapshot.config_rows(spark, config).first()[0]) == snapshot.cleansed(config)
    deep = spark.sql("select 1 a, named_struct('b', 2, 'c', named_struct('d', 3, 'e', 4)) s, 5 z")
    assert snapshot.only_fields(deep, {"s": {"c": {"e": True}}, "z": True}).schema.simpleString() == "struct<s:struct<c:struct<e:int>>,z:int>"
    spark.sql("CREATE DATABASE IF NOT EXISTS mesh_test")
    snapshot.create_tables(spark, "mesh_test")
    assert spark.sql("SHOW TABLES IN mesh_test").count() == len(snapshot.TABLES)


def test_counter_mode_vector(spark):
    """The key stream's first block of the published AES-128 counter mode example, with its counter block."""
    key, counter = "2b7e151628aed2a6abf7158809cf4f3c", "f0f1f2f3f4f5f6f7f8f9fafb00000000"
    block = F.substring(F.aes_encrypt(F.unhex(F.lit(counter)), F.unhex(F.lit(key)), F.lit("ECB"), F.lit("PKCS")), 1, 16)
    packet, sender = int.from_bytes(bytes.fromhex(counter[:16]), "little", signed=True), int.from_bytes(bytes.fromhex(counter[16:24]), "little")
    row = spark.range(1).select(decode.decrypted(F.unhex(F.lit("00" * 16)), F.unhex(F.lit(key)), F.lit(packet), F.lit(sender)).alias("stream"), block.alias("block")).first()
    assert row["stream"] == row["block"]


@pytest.mark.parametrize("name", ["packet_nodes", "packet_nodes_stream", "graph_tree", "traceroute_history", "decrypted_texts", "nodes_filtered"])
def test_query_has_its_sql_rows(spark, name):
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{SF}/events.parquet'")
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    flat = lambda rows: sorted(tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in rows)
    assert flat(df.select(*cols).collect()) == flat(con.sql(registry.ORACLE_SQL[name]).project(",".join(cols)).fetchall())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_found_node_computes_the_nodes_once(spark):
    n = spark.range(9).selectExpr("lpad(hex(id), 8, '0') id", "'N' || id % 3 shortname")
    found = nodes.found_node(n, spark.createDataFrame([("!00000004",), (" n2",), ("n7",), (None,), (" n2",)], "said string"))
    assert plan_of(found).count("Range (") == 1
    assert sorted((r.said or "", r.id) for r in found.collect()) == [("", None), (" n2", "00000002"), (" n2", "00000002"), ("!00000004", "00000004"), ("n7", None)]


def test_events_are_spread_before_they_are_decoded(spark):
    """A file of one row group is one task's; nothing is computed of its rows there."""
    plan = plan_of(model.messages(spark, "/root/testdata/sf0.001"))
    assert plan.index("get_json_object") < plan.index("Exchange hashpartitioning(event_id")
