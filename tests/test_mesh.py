"""Scalar functions, state fold, graph and decoding against values worked out by hand."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from radiolake.functions import mesh as m
from radiolake.operators import graph, state
from radiolake.plans import registry as catalog
from radiolake.sources import decode, model

SF = "/root/testdata/sf0.001"


def one(spark, column, value=1):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("number", "text"), [(255, "000000ff"), (4294967295, "ffffffff"), (4294967296, "100000000")])
def test_hex_ids(spark, number, text):
    assert one(spark, m.hex_id(F.lit(number))) == text
    assert one(spark, m.int_id(F.lit("!" + text))) == number


@pytest.mark.parametrize(("raw", "found"), [("16909060", "16909060"), ("255", "000000ff"), ("!0102030a", "0102030a"), ("12345678", "12345678")])
def test_parse_id(spark, raw, found):
    assert one(spark, m.parse_id(F.lit(raw))) == found


def test_ids_of_nothing(spark):
    text = lambda x: F.lit(x).cast("string")
    assert one(spark, m.hex_id(F.lit(None).cast("long"))) is None and one(spark, m.uptime(F.lit(None).cast("long"))) is None
    assert [one(spark, m.int_id(text(x))) for x in (None, "", "zz", "12g", "1" * 23, "!0000000F")] == [None, None, None, None, None, 15]
    assert [one(spark, m.parse_id(text(x))) for x in (None, "12345678901234567890123", "-5", " 255 ")] == [None, None, None, "000000ff"]
    assert [one(spark, m.valid_id(text(x))) for x in (None, "    null", "!0102030a", "102030a")] == [False, True, True, False]
    assert m.parse_ids(" 3,!0000000c,,0000000C, 12345678") == ["00000003", "0000000c", "12345678"] and m.parse_ids(None) == []
    m.register(spark)
    assert spark.sql("select mesh_hex(null), mesh_int('zz'), mesh_int(null)").first()[:] == (None, None, None)


def test_sign_of_zero(spark):
    assert [one(spark, m.with_unit(F.lit(x), " mA", 2)) for x in ("-0.0", "-0.001", "0.0", "0.001", "-0.01", "-")] == ["-0.00 mA", "-0.00 mA", "0.00 mA", "0.00 mA", "-0.01 mA", "-"]


def test_ids_beyond_a_day(spark, tmp_path):
    """As the SQL has it: hours, minutes and seconds in full, days always 0."""
    spark.createDataFrame([(x,) for x in (0, 1, 2, 86399, 86400, 90061, 864001)], "c_custkey long").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"create view customer as select * from read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    expected = con.execute(__spark_entry__.oracle_sql()["ids_with_gaps"]).fetchall()
    found = [tuple(r) for r in __spark_entry__.queries()["ids_with_gaps"](spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted(expected) and "0d 25h 1501m 1s" in [r[-1] for r in found]


def test_distance(spark):
    d = one(spark, m.haversine_km(*map(F.lit, (38.58, -121.49, 37.77, -122.42))))
    assert 115 < d < 125
    assert one(spark, m.haversine_km(*map(F.lit, (1.0, 2.0, 1.0, 2.0)))) == 0
    assert one(spark, m.distance_km(F.lit(None).cast("double"), *map(F.lit, (2.0, 1.0, 2.0)))) is None


def test_small_functions(spark):
    assert one(spark, m.seconds_within_day(F.lit(86_700_000_000))) == 300
    assert one(spark, m.uptime(F.lit(90061))) == "1d 25h 1501m 1s"
    assert one(spark, m.little_endian64(F.lit(258))) == bytearray(b"\x02\x01" + bytes(6))
    assert one(spark, m.initials(F.lit("Alpha Hill"))) == "AH"
    assert one(spark, m.number_or_null(F.lit("x"))) is None
    assert one(spark, m.mercator_x(F.lit(180.0))) == pytest.approx(math.pi * 6378137)
    assert [one(spark, m.topic_matches(F.lit("msh/US/2/json/a"), t)) for t in ("msh/#", "msh/+/2/#", "msh/+/json/#")] == [True, True, False]


def test_sql_functions(spark):
    m.register(spark)
    assert spark.sql("select mesh_int(mesh_hex(77)) x, haversine_km(0, 0, 0, 1) d").first()[0] == 77


def test_fold_of_parts_is_the_fold_of_all(spark):
    log = spark.createDataFrame([(1, 5, 10, "view", 1.0, 7), (2, 5, 20, "signup", 2.0, 8), (3, 6, 30, "click", 3.0, 9), (4, 5, 40, "view", None, 1)], "seq long, from_num long, ts_us long, kind string, value double, k long")
    whole = sorted(state.current(state.fold(log)).collect())
    for cut in range(5):
        a, b = state.fold(log.filter(f"seq <= {cut}")), state.fold(log.filter(f"seq > {cut}"))
        for x, y in ((a, b), (b, a)):
            assert sorted(state.current(state.merge(x, y)).select(*state.current(state.fold(log)).columns).collect()) == whole


def test_activity_bounds(spark):
    now = F.lit(10 * 86_400_000_000)
    ages = [7199, 7200, 86400 + 300]
    rows = spark.createDataFrame([(10 * 86_400_000_000 - a * 1_000_000,) for a in ages], "t long")
    assert [r[0] for r in rows.select(state.is_active(F.col("t"), now, 7200)).collect()] == [True, False, False]
    assert [r[0] for r in rows.select(state.is_active(F.col("t"), now, 7200, within_day=True)).collect()] == [True, False, True]


def test_overlay_seed_enrich(spark):
    n = spark.createDataFrame([("a", 1), ("b", 2)], "id string, lat int")
    o = spark.createDataFrame([("a", None), ("z", 9)], "id string, lat int")
    assert sorted(map(tuple, state.overlaid(n, o, ["lat"]).collect())) == [("a", None), ("b", 2)]
    assert sorted(map(tuple, state.enriched(n, o, ["lat"]).collect())) == [("a", 1), ("b", 2)]
    assert sorted(r[0] for r in state.seeded(n, o).collect()) == ["a", "b", "z"]


def test_reach_and_tree(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(2, 0)], "src long, dst long")
    assert dict(graph.reach(chain, 0).collect()) == {i: i for i in range(11)}
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c"), ("b", "a"), ("c", "b"), ("c", "d"), ("d", "e"), ("x", "y")], "src string, dst string")
    rows = sorted(map(tuple, graph.tree(edges, "a", 3).collect()))
    assert rows == [("a", "a", 0, True), ("a>b", "b", 1, True), ("a>b>c", "c", 2, False), ("a>c", "c", 1, True), ("a>c>b", "b", 2, False), ("a>c>d", "d", 2, True), ("a>c>d>e", "e", 3, True)]
    assert sorted(map(tuple, graph.tree(edges, "y").collect())) == [("y", "y", 0, True)]


def test_lists_of_a_hub_in_chunks(spark):
    """A hub with a third of all edges is built by several tasks; its chunks, joined, are its list."""
    rng = random.Random(5)
    rows = [("hub", f"{rng.randrange(900):04d}") for _ in range(1500)] + [(f"n{rng.randrange(300)}", f"{rng.randrange(50):04d}") for _ in range(3000)] + [(None, "x"), ("y", None), ("z", "one")]
    edges = spark.createDataFrame(rows, "src string, dst string").repartition(6)
    chunks = graph.chunked_lists(edges, "src", "dst", 40).withColumn("part", F.spark_partition_id()).collect()
    lists, expected = {}, {}
    for r in sorted(chunks, key=lambda r: r["chunk"]):
        own = lists.setdefault(r["src"], [])
        assert r["before"] == len(own) and 0 < len(r["values"]) <= 40
        own.extend(r["values"])
    for a, b in rows:
        if a is not None and b is not None:
            expected.setdefault(a, set()).add(b)
    assert lists == {k: sorted(v) for k, v in expected.items()} and len([r for r in chunks if r["src"] == "hub"]) >= len(expected["hub"]) // 40
    assert graph.chunked_lists(edges.limit(0), "src", "dst").count() == 0


def test_decoding(spark):
    body = '{"from":16909060,"to":4294967295,"channel":0,"type":"position","timestamp":1,"payload":{"latitude_i":5,"longitude_i":-6}}'
    msgs = spark.createDataFrame([(1, "msh/X/2/json/a", body), (2, "msh/X/2/json/a", "junk"), (3, "other/x", body)], "seq long, topic string, body string")
    rows = decode.envelopes(decode.subscribed(msgs, ["msh/#"])).collect()
    assert [(r["type"], r["from"], r["to"]) for r in rows] == [("position", "01020304", "ffffffff"), ("unknown", None, None)]
    p = decode.payloads(decode.envelopes(msgs.limit(1)), "position").first()
    assert p["p"]["latitude_i"] == 5


def test_ctr_decryption_is_its_own_inverse(spark):
    key, data = F.unhex(F.lit("2b7e151628aed2a6abf7158809cf4f3c")), F.lit(b"a text of more than sixteen bytes")
    once = decode.decrypted(data, key, F.lit(77), F.lit(5))
    row = spark.range(1).select(once.alias("c")).withColumn("back", decode.decrypted(F.col("c"), key, F.lit(77), F.lit(5))).first()
    assert bytes(row["back"]) == b"a text of more than sixteen bytes" and bytes(row["c"]) != bytes(row["back"])


def test_registry_and_entry(spark):
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["nodes_active", "chat_dedupe", "graph_reach", "stream_fold"])
def test_query_has_its_sql_rows(spark, name):
    con = duckdb.connect()
    for t in ("customer", "events", "conversations", "orders", "lineitem", "supplier", "part", "nation"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    flat = lambda rows: sorted(tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in rows)
    assert flat(df.select(*cols).collect()) == flat(con.sql(catalog.ORACLE_SQL[name]).project(",".join(cols)).fetchall())


def sql_rows(name):
    con = duckdb.connect()
    for t in ("events", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return sorted(con.sql(catalog.ORACLE_SQL[name]).fetchall())


def test_reach_over_all_edges(spark):
    """Breadth-first search by hand, over every edge of the tables."""
    near = {}
    for src, dst in model.edges(spark, SF).select("src", "dst").collect():
        near.setdefault(src, set()).add(dst)
    level, front = {7: 0}, {7}
    for depth in range(1, 11):
        front = {d for s in front for d in near.get(s, ())} - set(level)
        level |= dict.fromkeys(front, depth)
    out = catalog.QUERIES["graph_reach_all"](spark, SF).select("node", "level").collect()
    assert dict(out) == level and len(out) == len(level)
    assert sorted(map(tuple, out)) == sql_rows("graph_reach_all")


def test_chat_copies_within_each_channel(spark, tmp_path):
    """Every conversation has its rows; equal ids of other channels stay apart."""
    out = catalog.QUERIES["chat_dedupe_all"](spark, SF)
    messages = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn").distinct().count()
    assert out.count() == messages and sorted(map(tuple, out.collect())) == sql_rows("chat_dedupe_all")
    planted = [(70, 1, "b", "y"), (70, 1, "a", "x"), (71, 1, "c", "z"), (5, 1, "a", "w")]
    spark.createDataFrame(planted, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = sorted(map(tuple, catalog.QUERIES["chat_dedupe_all"](spark, str(tmp_path)).collect()))
    assert rows == [("5", 1, "a", "w", 1), ("70", 1, "a,b", "y", 2), ("71", 1, "c", "z", 1)]
