"""The stream of activity against a replay in plain Python, with late, repeated and unordered packets, and after a restart."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from radiolake.streaming import activity, fold

SCHEMA = "id string, ts timestamp, ts_us long, makes_known boolean"
START = 1_700_000_000_000_000
MINUTE = 60_000_000


def row(node, us, known=True):
    return (node, datetime.datetime.fromtimestamp(us / 1e6, datetime.UTC), us, known)


def replay(rows, now, silence=7_200_000_000):
    out = []
    for node in sorted({r[0] for r in rows}):
        last, active = None, False
        for _, _, at, known in sorted((r for r in rows if r[0] == node), key=lambda r: (r[2], r[3])):
            if last is None and not known:
                continue
            if active and at - last >= silence:
                out.append((node, "expired", last + silence, None))
                active = False
            if not active:
                out.append((node, "appeared", at, None) if last is None else (node, "returned", at, at - last))
            last, active = at, True
        if active and last + silence <= now:
            out.append((node, "expired", last + silence, None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def packets():
    rng = random.Random(7)
    rows = [row(f"{rng.randrange(12):08x}", START + rng.randrange(3_000) * MINUTE + rng.randrange(1_000), rng.random() < 0.7) for _ in range(500)]
    rows += rows[:60]  # repeated
    rows += [row("0000000a", START + 5 * MINUTE, False), row("0000000f", START + MINUTE, False), row("0000000e", START + 7 * MINUTE)]
    return sorted(rows, key=lambda r: r[2])


def run(spark, folder, batches):
    """Each batch is a file; the query ends and starts again from its checkpoint after every one."""
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = fold.read_log(spark, f"{folder}/in", spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
        activity.transitions_stream(stream, f"{folder}/out", f"{folder}/offsets").awaitTermination()
    return sorted((tuple(r) for r in activity.read_transitions(spark, f"{folder}/out").select("id", "event", "at_us", "since_us").collect()), key=str)


def test_restarted_stream_is_the_replay(spark, packets, tmp_path):
    """Packets up to ten minutes late, out of order; a node that falls silent expires by other nodes' packets."""
    rng = random.Random(8)
    arrived = sorted(packets, key=lambda r: r[2] + rng.randrange(9 * MINUTE))
    end = packets[-1][2] + 10_000 * MINUTE
    batches = [arrived[:200], arrived[200:420], [*arrived[420:], row("clock", end + 11 * MINUTE, False)]]
    for batch in batches:
        rng.shuffle(batch)
    out = run(spark, tmp_path, batches)
    assert out == replay(packets, end)
    assert len({r[0] for r in out}) == 13 and {r[1] for r in out} == {"appeared", "expired", "returned"}


def test_state_is_kept_by_shard(spark, tmp_path):
    """Many nodes are few calls: the state has a row a shard, not one a node."""
    rows = [row(f"{i:08x}", START + i) for i in range(3_000)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    query = activity.transitions_stream(fold.read_log(spark, f"{tmp_path}/in", spark.createDataFrame([], SCHEMA).schema), f"{tmp_path}/out", f"{tmp_path}/offsets")
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 256
    out = run(spark, tmp_path, [[row("clock", START + 10_000 * MINUTE, False)]])
    assert sorted((r[0], r[1]) for r in out) == sorted((r[0], e) for r in rows for e in ("appeared", "expired"))


def test_silence_expires_without_a_packet_of_the_node(spark, tmp_path):
    first = [row("0000000a", START), row("0000000b", START)]
    assert run(spark, tmp_path, [first])[:1] in ([], [("0000000a", "appeared", START, None)])
    out = run(spark, tmp_path, [[row("0000000b", START + 131 * MINUTE)]])
    assert ("0000000a", "expired", START + 120 * MINUTE, None) in out and ("0000000b", "expired", START + 120 * MINUTE, None) in out
    assert ("0000000b", "returned", START + 131 * MINUTE, 131 * MINUTE) not in out  # the watermark hasn't passed it yet


def test_table_is_the_replay(spark, packets):
    now = packets[-1][2]
    out = activity.transitions(spark.createDataFrame(packets, SCHEMA), F.lit(now)).select("id", "event", "at_us", "since_us").collect()
    assert sorted((tuple(r) for r in out), key=str) == replay(packets, now)
    assert activity.transitions(spark.createDataFrame([], SCHEMA), F.lit(now)).count() == 0


def test_previous_across_chunks(spark):
    rng = random.Random(9)
    rows = [(k, rng.randrange(100)) for k in "aab" for _ in range(60)] + [("c", 5), ("c", 5)]
    got = sorted(tuple(r) for r in activity.previous(spark.createDataFrame(rows, "id string, ts_us long"), "id", chunk_us=7).select("id", "ts_us", F.coalesce("previous_us", F.lit(-1))).collect())
    expected = []
    for k in "abc":
        own = sorted(t for i, t in rows if i == k)
        expected += [(k, t, p) for p, t in zip([-1, *own], own, strict=False)]
    assert got == sorted(expected)


def test_sessions_of_late_repeated_and_unordered_packets(spark, packets, tmp_path):
    rng, known = random.Random(11), []
    for i, r in enumerate(packets):
        known.append((r[0], i, r[1], r[2], r[3]))
    arrived = sorted(known + known[::3], key=lambda r: r[3] + rng.randrange(9 * MINUTE))
    schema = "id string, seq long, ts timestamp, ts_us long, makes_known boolean"
    batches = [arrived[:250], arrived[250:500], [*arrived[500:], ("clock", -1, *row("clock", packets[-1][2] + 9_000 * MINUTE)[1:])]]
    for batch in batches:
        rng.shuffle(batch)
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = fold.sessions(fold.read_log(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, files_per_batch=1), once=True)
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/offsets").trigger(availableNow=True).start().awaitTermination()
    expected = []
    for node in sorted({r[0] for r in known}):
        own = sorted(r[3] for r in known if r[0] == node)
        cuts = [0, *(i for i in range(1, len(own)) if own[i] - own[i - 1] >= 120 * MINUTE), len(own)]
        expected += [(node, own[a], own[b - 1] + 120 * MINUTE, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
    out = spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").filter("id <> 'clock'").collect()
    assert sorted(map(tuple, out)) == sorted(expected)
