"""Dated sets of tables under readers and failures; objects of records with unknown members."""

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from radiolake.sources.archive import Archive, load_objects, own_id, save_objects

T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def tables(spark, n):
    return {"nodes": spark.range(n).toDF("id"), "chat": spark.createDataFrame([(n, "hi!")], "n int, text string")}


def test_newest_sets_stay(spark, tmp_path):
    archive = Archive(spark, f"{tmp_path}/a", keep=3)
    assert archive.load() == {} and archive.sets() == []
    names = [archive.publish(tables(spark, n), T0 + datetime.timedelta(hours=n)) for n in (1, 2, 5, 3, 4)]
    assert archive.sets() == sorted(names)[-3:]
    newest = archive.load()
    assert sorted(newest) == ["chat", "nodes"] and newest["nodes"].count() == 5 and newest["chat"].first()["text"] == "hi!"
    assert archive.publish(tables(spark, 9), T0 + datetime.timedelta(hours=5)) == names[2] and archive.load()["nodes"].count() == 5  # published once
    assert archive.load(sorted(names)[-2])["nodes"].count() == 4


def test_half_a_set_is_never_seen(spark, tmp_path):
    archive = Archive(spark, f"{tmp_path}/a", keep=2)
    archive.publish(tables(spark, 1), T0)
    broken = spark.range(3).select(F.raise_error(F.lit("dies")).alias("x"))
    with pytest.raises(Exception, match="dies"):
        archive.publish({"chat": tables(spark, 2)["chat"], "nodes": broken}, T0 + datetime.timedelta(days=1))
    assert len(archive.sets()) == 1 and archive.load()["nodes"].count() == 1
    assert any(n.startswith("_begun-") for n, _ in archive.listed())
    archive.retain()  # it may still be written to
    assert any(n.startswith("_begun-") for n, _ in archive.listed())
    archive.retain(abandoned_s=-10)
    assert [n for n, _ in archive.listed()] == archive.sets()


def test_objects_keep_unknown_members(spark, tmp_path):
    a = {"!0000000a": {"id": "!0000000a", "longname": 'says "hi!", {"k":1}', "later": {"deep": [1, {"x": None}]}}, "0000000b": {"id": 11, "n": 1.5}}
    b = {"short": {"id": "x"}, "!0000000c": {"text": "!keep! é\n"}, "!0000000d": None}
    os.makedirs(f"{tmp_path}/in")
    for name, value in (("a", a), ("b", b), ("bad", [1]), ("worse", None)):
        with open(f"{tmp_path}/in/{name}.json", "w") as f:
            f.write("{cut" if name == "worse" else json.dumps(value, indent=2))
    rows = load_objects(spark, f"{tmp_path}/in")
    expected = {"0000000a": a["!0000000a"], "0000000b": a["0000000b"], "0000000c": b["!0000000c"], "0000000d": None}
    found = lambda df: {r["id"]: json.loads(r["j"]) for r in df.select("id", F.to_json("record").alias("j")).collect()}
    assert found(rows) == expected
    assert {r["id"]: r["named"] for r in own_id(rows).collect()} == {"0000000a": "0000000a", "0000000b": None, "0000000c": None, "0000000d": None}
    for each in (10, 1):
        save_objects(rows, f"{tmp_path}/out{each}", each)
        assert found(load_objects(spark, f"{tmp_path}/out{each}")) == expected
    save_objects(rows.limit(0), f"{tmp_path}/none")
    typed = spark.createDataFrame([("0000000a", {"x": 1})], "id string, r map<string,int>").select("id", F.struct(F.col("r").alias("m")).alias("record"))
    save_objects(typed, f"{tmp_path}/typed")
    assert found(load_objects(spark, f"{tmp_path}/typed")) == {"0000000a": {"m": {"x": 1}}}


def test_records_are_made_once(spark, tmp_path):
    """Counting the records for their files doesn't make them again; nothing is left beside the files."""
    made = spark.sparkContext.accumulator(0)

    def one(id_):
        made.add(1)
        return True

    rows = spark.range(50).select(F.lower(F.lpad(F.hex("id"), 8, "0")).alias("id"), F.struct("id").alias("record")).filter(F.udf(one, "boolean")("id"))
    save_objects(rows, f"{tmp_path}/once", 10)
    assert made.value == 50 and [f.name for f in tmp_path.iterdir()] == ["once"]
    assert load_objects(spark, f"{tmp_path}/once").count() == 50
