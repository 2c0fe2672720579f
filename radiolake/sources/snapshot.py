"""Snapshots and logs as files: JSON tables written and loaded with clean ids, the table definitions, configuration."""

from __future__ import annotations

import json
import re
import tempfile
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from radiolake.functions.mesh import iso_time, known_id

#: What a configuration holds that no view may show.
SECRETS = ("username", "password", "token", "api_key", "key")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a new temporary one only where all runs in one local process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def use_checkpoints(spark: SparkSession) -> None:
    """Let ``checkpoint()`` write to the shared folder."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def save(table: DataFrame, path: str) -> None:
    """Replace a snapshot: JSON lines, keys in order, times in ISO form, intervals left out."""
    out = []
    for f in sorted(table.schema.fields, key=lambda f: f.name):
        if isinstance(f.dataType, T.DayTimeIntervalType):
            continue
        out.append((iso_time(F.col(f.name)) if isinstance(f.dataType, T.TimestampType) else F.col(f.name)).alias(f.name))
    table.select(*out).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def load(spark: SparkSession, path: str, schema: T.StructType, key: str = "id") -> DataFrame:
    """A snapshot's rows that have a usable id, without its mark."""
    rows = spark.read.schema(schema).json(path).withColumn(key, known_id(F.col(key)))
    return rows.filter(F.col(key).isNotNull())


def append_log(messages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A stream of messages as an append-only log of JSON lines."""
    whole = messages.select(F.to_json(F.struct("*")).alias("value"))
    return whole.writeStream.format("text").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cleansed(config: Any, secrets: tuple[str, ...] = SECRETS) -> Any:
    """A copy of a nested configuration without its secrets."""
    if isinstance(config, dict):
        return {k: cleansed(v, secrets) for k, v in config.items() if k not in secrets}
    return [cleansed(v, secrets) for v in config] if isinstance(config, list) else config


def config_rows(spark: SparkSession, config: dict) -> DataFrame:
    """A configuration without its secrets as one row of JSON."""
    return spark.createDataFrame([(json.dumps(cleansed(config), sort_keys=True),)], "config string")


def only_fields(table: DataFrame, wanted: dict[str, Any]) -> DataFrame:
    """The columns that ``wanted`` names, of structs only the members that their dicts name; others are left out."""

    def pick(path: str, kind: T.DataType, spec: Any):
        if not isinstance(spec, dict) or not isinstance(kind, T.StructType):
            return F.col(path)
        members = [pick(f"{path}.{f.name}", f.dataType, spec[f.name]).alias(f.name) for f in kind.fields if f.name in spec]
        return F.when(F.col(path).isNotNull(), F.struct(*members))

    return table.select(*[pick(f.name, f.dataType, wanted[f.name]).alias(f.name) for f in table.schema.fields if f.name in wanted])


#: The normalised model's tables.
TABLES = {
    "nodes": "id BIGINT NOT NULL, first_heard_at TIMESTAMP NOT NULL, last_heard_at TIMESTAMP NOT NULL",
    "node_infos": "id BIGINT NOT NULL, node_id BIGINT NOT NULL, long_name STRING, short_name STRING, mac_addr STRING, hw_model STRING, role STRING, created_at TIMESTAMP NOT NULL",
    "node_positions": "id BIGINT NOT NULL, node_id BIGINT NOT NULL, latitude DOUBLE NOT NULL, longitude DOUBLE NOT NULL, altitude DOUBLE, created_at TIMESTAMP NOT NULL",
    "channels": "id STRING NOT NULL, name STRING",
    "text_messages": "id BIGINT NOT NULL, channel_id STRING NOT NULL, from_id BIGINT NOT NULL, to_id BIGINT, sender_id BIGINT, text STRING, hops_away INT, rssi INT, snr DOUBLE, created_at TIMESTAMP NOT NULL",
    "messages": "id BIGINT NOT NULL, mqtt_message_id BIGINT, type STRING, from_id BIGINT, to_id BIGINT, sender_id BIGINT, channel INT, payload STRING, created_at TIMESTAMP NOT NULL",
    "mqtt_messages": "id BIGINT NOT NULL, topic STRING NOT NULL, payload STRING, qos INT, retain BOOLEAN, created_at TIMESTAMP NOT NULL",
}


def create_tables(spark: SparkSession, database: str = "default") -> None:
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")
