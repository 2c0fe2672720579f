"""Sinks at their own intervals, by a clock that is set, with repeated batches and sinks that die."""

import pytest

from radiolake.streaming import fold
from radiolake.streaming.dispatch import Dispatcher, Every, batch_files, raw_and_clean, read_batches


def test_intervals_and_repeats(spark, tmp_path):
    clock, ran = [0.0], []
    sinks = {n: Every(s, lambda batch, k, now, n=n: ran.append((n, k, now))) for n, s in (("log", 0), ("snapshot", 300), ("lookup", 900))}
    rows = spark.range(3)
    for k, at in enumerate([0, 100, 299, 300, 650, 899, 900, 1000]):
        clock[0] = at
        for _ in range(2):  # every batch runs twice
            Dispatcher(spark, f"{tmp_path}/clocks", sinks, lambda: clock[0]).run(rows, k)
    assert [x for x in ran if x[0] == "log"] == [("log", k, at) for k, at in enumerate([0, 100, 299, 300, 650, 899, 900, 1000])]
    assert [(n, at) for n, _, at in ran if n == "snapshot"] == [("snapshot", t) for t in (0, 300, 650, 1000)]
    assert [(n, at) for n, _, at in ran if n == "lookup"] == [("lookup", t) for t in (0, 900)]


def test_a_batch_that_died_is_written_once(spark, tmp_path):
    alive = [False]

    def dying(batch, n, now):
        if not alive[0]:
            raise OSError("dies")

    sinks = {"log": Every(0, batch_files(f"{tmp_path}/log")), "other": Every(0, dying)}
    run = lambda n: Dispatcher(spark, f"{tmp_path}/clocks", sinks, lambda: 5.0).run(spark.range(10 * n, 10 * n + 10), n)
    with pytest.raises(OSError, match="dies"):
        run(0)
    alive[0] = True
    for n in (0, 0, 1, 1):
        run(n)
    assert sorted(r["id"] for r in read_batches(spark, f"{tmp_path}/log").collect()) == list(range(20))


def test_raw_and_clean_logs_of_a_stream(spark, tmp_path):
    rows = [(i, i, "t", bytearray(b"{broken" if i % 5 == 0 else b'{"id": 1}')) for i in range(20)]
    whole = spark.createDataFrame(rows, "seq long, ts_us long, topic string, body binary")
    whole.repartition(3).write.parquet(f"{tmp_path}/m")
    for _ in range(2):  # the second run finds nothing new
        dispatcher = Dispatcher(spark, f"{tmp_path}/clocks", raw_and_clean(f"{tmp_path}/logs"))
        dispatcher.start(fold.read_log(spark, f"{tmp_path}/m", whole.schema, files_per_batch=1), f"{tmp_path}/offsets").awaitTermination()
    raw, clean = (sorted(r["seq"] for r in read_batches(spark, f"{tmp_path}/logs/{n}").collect()) for n in ("raw", "clean"))
    assert raw == list(range(20)) and clean == [i for i in range(20) if i % 5]
