"""The recorded frames' source: whole lines only, parts that meet at any byte, topics, malformed frames, restarts."""

import base64
import json
import os
import random

import pytest

from radiolake.sources import frames


def line(seq, topic="msh/XX/2/json/a", body=b"{}"):
    return json.dumps({"seq": seq, "ts_us": seq * 10, "topic": topic, "body": base64.b64encode(body).decode()}).encode() + b"\n"


def write(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "ab") as f:
        f.write(data)


@pytest.fixture(scope="module")
def source(spark):
    frames.register(spark)
    return lambda path, **options: spark.readStream.format("broker_frames").options(path=str(path), **options).load()


def run(source, base, **options):
    stream = source(f"{base}/in", **options).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/offsets").trigger(availableNow=True).start()
    stream.awaitTermination()


def test_parts_meet_at_any_byte(tmp_path):
    rng = random.Random(2)
    data = b"".join(line(i, body=rng.randbytes(rng.randrange(40))) for i in range(60)) + b"\n\nno frame\n" + line(99)
    write(f"{tmp_path}/b/0/s", data)
    for size in (1, 7, 50, 333, 10**6):
        recording = frames.Recording({"path": str(tmp_path), "part_bytes": str(size)})
        found = [x for part in recording.between({}, recording.newest()) for x in recording.lines(part)]
        assert [x for _, x in found] == data.split(b"\n")[:-1] and all(data[at:].startswith(x) for at, x in found)


def test_filters():
    fits = frames.topic_fits
    assert fits("a/b/c", "a/b/c") and fits("a/b/c", "a/+/c") and fits("a/b/c", "a/#") and fits("a", "a/#") and fits("a/b", "#") and fits("a/b", "+/+")
    assert not fits("a/b/c", "a/b") and not fits("a/b", "a/b/c") and not fits("b/b", "a/#") and not fits("a/b/c", "a/+")


def test_restarts_lose_and_repeat_nothing(spark, source, tmp_path):
    """Between runs segments grow, new ones and a new broker come; a line is cut and finished later."""
    base, rng, sent = tmp_path, random.Random(3), []
    for round_ in range(4):
        for broker in "xyz"[: 1 + round_ // 2 + 1]:
            own = [line(len(sent) + i) for i in range(rng.randrange(1, 30))]
            sent += [(len(sent) + i, broker) for i in range(len(own))]
            path = f"{base}/in/{broker}/{round_ // 2:04d}/s"
            data = b"".join(own)
            cut = len(data) if round_ in (1, 3) else len(data) - rng.randrange(1, 20)
            write(path, data[:cut])
            if cut < len(data):
                write(f"{base}/later/{broker}", data[cut:])
        run(source, base, part_bytes="200")
        for broker in os.listdir(f"{base}/later") if os.path.exists(f"{base}/later") else []:
            with open(f"{base}/later/{broker}", "rb") as f:
                write(f"{base}/in/{broker}/{round_ // 2:04d}/s", f.read())
            os.remove(f"{base}/later/{broker}")
    run(source, base)
    out = spark.read.schema(source(f"{base}/in").schema).parquet(f"{base}/out").collect()
    assert sorted((r["seq"], r["broker"]) for r in out) == sorted(sent) and all(r["error"] is None for r in out)
    assert spark.read.format("broker_frames").option("path", f"{base}/in").load().count() == len(sent)


def test_malformed_frames_are_rows(spark, source, tmp_path):
    bad = [b"{broken", b"[]", b"", b'{"seq": "x", "ts_us": 1, "topic": "a"}', b'{"seq": 1, "ts_us": 1, "topic": "a", "body": "***"}', b'{"seq": 1e400, "ts_us": 1, "topic": "a"}', b'{"seq": 1, "ts_us": 99999999999999999999999, "topic": "a"}', b"\xff\xfe", b"null"]
    good = [line(1, "m/a/2"), line(2, "m/b/2"), line(3, "n/a"), line(4, "o/x/y")]
    write(f"{tmp_path}/in/b/0/s", b"\n".join(bad) + b"\n" + b"".join(good))
    run(source, tmp_path, topics="m/+/2,o/#")
    out = spark.read.schema(source(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/out").collect()
    assert sorted(r["seq"] for r in out if r["error"] is None) == [1, 2, 4]
    assert sorted(bytes(r["body"]) for r in out if r["error"]) == sorted(bad)
    assert spark.read.format("broker_frames").option("path", f"{tmp_path}/none").load().count() == 0


def test_large_batches_have_bounded_parts(tmp_path):
    """Parts grow with a batch, as each costs a task and a file, and still hold each line once."""
    (tmp_path / "one").mkdir()
    line = json.dumps({"seq": 1, "ts_us": 1, "topic": "a", "body": ""}) + "\n"
    (tmp_path / "one" / "0").write_text(line * 9_000)
    recording = frames.Recording({"path": str(tmp_path), "part_bytes": "1000"})
    parts = recording.between({}, recording.newest())
    assert 2 < len(parts) <= frames.PARTS + 1 and sum(len(list(recording.lines(p))) for p in parts) == 9_000
    few = recording.between({"one": ["0", len(line) * 8_900]}, recording.newest())
    assert all(p.end - p.start <= 1000 for p in few) and sum(p.end - p.start for p in few) == 100 * len(line)
