"""Streaming folds of the packet log.

The fold is a streaming aggregation, so Spark keeps the state by key and a micro-batch reads and
writes only the keys that it touches. The keys that changed are committed to a ``StateTable``, once a batch, however often
a batch runs; the current state is read from there at the cost of the live keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from radiolake.operators.nodes import fold_nodes
from radiolake.operators.state import fold
from radiolake.streaming.state_table import StateTable


def read_log(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def changes(folded: DataFrame, state_dir: str, checkpoint_dir: str, key: str) -> StreamingQuery:
    """Commit the keys that each batch of a streaming aggregation changed."""
    table = StateTable(folded.sparkSession, state_dir, key)
    return folded.writeStream.outputMode("update").foreachBatch(table.commit).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()


def latest(spark: SparkSession, state_dir: str, key: str) -> DataFrame:
    """The newest row of each key."""
    return StateTable(spark, state_dir, key).read()


def fold_stream(log: DataFrame, state_dir: str, checkpoint_dir: str) -> StreamingQuery:
    """Fold a stream of log rows per sender."""
    return changes(fold(log), state_dir, checkpoint_dir, "from_num")


def node_stream(packets: DataFrame, state_dir: str, checkpoint_dir: str) -> StreamingQuery:
    """Fold a stream of typed packets per node."""
    return changes(fold_nodes(packets), state_dir, checkpoint_dir, "id")


def latest_nodes(spark: SparkSession, state_dir: str) -> DataFrame:
    return latest(spark, state_dir, "id")


def windowed_counts(log: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Packets a kind and window of event time, closed by a watermark (an addition to the model)."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("packets"))


def sessions(heard: DataFrame, gap_s: int = 7200, late: str = "10 minutes", once: bool = False) -> DataFrame:
    """(id, first_us, end_us, packets): spells of packets of a node with gaps of less than ``gap_s``, of a table or a stream ``heard``.

    A stream's spell comes out once the watermark has passed its end. With ``once`` packets that repeat by ``seq`` within the watermark count once.
    """
    rows = heard.withWatermark("ts", late)
    if once:
        rows = rows.dropDuplicatesWithinWatermark(["id", "seq"]) if heard.isStreaming else rows.dropDuplicates(["id", "seq"])
    spells = rows.groupBy("id", F.session_window("ts", f"{gap_s} seconds").alias("spell")).agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count("*").alias("packets"))
    return spells.select("id", "first_us", (F.col("last_us") + gap_s * 1_000_000).alias("end_us"), "packets")
