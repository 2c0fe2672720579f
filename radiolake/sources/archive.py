"""Snapshots as dated sets of tables, published as a whole, and as JSON objects of records by id.

A set is written under a name that no reader looks at and then renamed to its date, so a reader sees all of its tables or none. The newest sets
stay; a set that was begun and never published is removed once it is old. All file work goes through the Hadoop file system of the path.
"""

from __future__ import annotations

import datetime
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.functions.mesh import known_id

DATED = re.compile(r"\d{8}T\d{6}\.\d{6}Z")


class Archive:
    def __init__(self, spark: SparkSession, path: str, keep: int = 7):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.files = self.hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def listed(self) -> list[tuple[str, int]]:
        """(name, time of change in ms) of all folders, begun ones too."""
        if not self.files.exists(self.hadoop.Path(self.path)):
            return []
        return sorted((f.getPath().getName(), f.getModificationTime()) for f in self.files.listStatus(self.hadoop.Path(self.path)))

    def sets(self) -> list[str]:
        """Published sets, the newest last."""
        return [n for n, _ in self.listed() if DATED.fullmatch(n)]

    def publish(self, tables: dict[str, DataFrame], at: datetime.datetime) -> str:
        """Write all tables as the set of a time; a set of that very time that is there already stays and is returned."""
        name = at.astimezone(datetime.UTC).strftime("%Y%m%dT%H%M%S.%fZ")
        place, made = self.hadoop.Path(f"{self.path}/{name}"), f"{self.path}/_begun-{uuid.uuid4().hex}"
        if not self.files.exists(place):
            for table, rows in tables.items():
                rows.write.parquet(f"{made}/{table}")
            if self.files.exists(place) or not self.files.rename(self.hadoop.Path(made), place):
                self.files.delete(self.hadoop.Path(made), True)
        self.retain()
        return name

    def retain(self, abandoned_s: int = 86_400) -> None:
        """Remove all but the newest sets, and what was begun long ago and not published."""
        old = self.sets()[: -self.keep]
        before = datetime.datetime.now(datetime.UTC).timestamp() * 1000 - abandoned_s * 1000
        for name, changed in self.listed():
            if name in old or name.startswith("_begun-") and changed < before:
                self.files.delete(self.hadoop.Path(f"{self.path}/{name}"), True)

    def load(self, name: str | None = None) -> dict[str, DataFrame]:
        """The tables of a set, by default the newest; none without any set."""
        name = name or (self.sets() or [None])[-1]
        if name is None:
            return {}
        folders = self.files.listStatus(self.hadoop.Path(f"{self.path}/{name}"))
        return {t: self.spark.read.parquet(f"{self.path}/{name}/{t}") for t in sorted(f.getPath().getName() for f in folders)}


def save_objects(records: DataFrame, path: str, each: int = 10_000) -> None:
    """Write ``records(id, record)``, a record being a variant or a struct, as files of one JSON object from id to record each, of about ``each`` records."""
    entry = F.concat(F.to_json(F.struct(F.col("id").alias("k"))), F.lit("\x00"), F.coalesce(F.to_json("record"), F.lit("null")))
    # written beside the files, so that the records are made once, and not once more to be counted
    spark, beside = records.sparkSession, f"{path.rstrip('/')}-entries-{uuid.uuid4().hex}"
    records.filter("id is not null").select("id", entry.alias("entry")).write.parquet(beside)
    entries = spark.read.schema("id string, entry string").parquet(beside)
    parts = max(1, -(-entries.count() // each))
    rows = entries.select(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), "entry")
    # {"k":"id"} and the record become "id":record
    pairs = F.transform(F.sort_array(F.collect_list("entry")), lambda e: F.regexp_replace(e, r'(?s)^\{"k":(.*?)\}\x00', r"$1:"))
    rows.groupBy("part").agg(F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")).alias("value")).select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(beside)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def load_objects(spark: SparkSession, path: str) -> DataFrame:
    """(id, record) of files of one JSON object from id to record each: ids without their mark, records as variants with all their members.

    Ids that are none are left out, and so are files that aren't an object; only the key and the record's own ``id`` lose the mark, by ``own_id``.
    """
    files = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    entries = files.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
    return entries.select(known_id(F.col("key")).alias("id"), F.col("value").alias("record")).filter("id is not null")


def own_id(records: DataFrame) -> DataFrame:
    """With ``named``: the id that each record gives itself, without its mark."""
    return records.withColumn("named", known_id(F.try_variant_get("record", "$.id", "string")))
