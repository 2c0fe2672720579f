"""One stream, several sinks, each at its own interval.

A batch goes to every sink that is due: one whose last run lies at least its interval back, by a clock that is given. When each ran last is kept in a
``StateTable`` that is committed once a batch, after its sinks: a batch that is run again after that does nothing, and one that died
before it goes to the same sinks again, with the same number. Sinks that write use that number as the name of what they write (``batch_files``),
so nothing is there twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from radiolake.streaming.state_table import StateTable

#: A sink is called with the batch, its number, and the clock's seconds.
Sink = Callable[[DataFrame, int, float], None]
CLOCKS = "sink string, last_s double"


@dataclass
class Every:
    seconds: float
    sink: Sink


class Dispatcher:
    def __init__(self, spark: SparkSession, path: str, sinks: dict[str, Every], clock: Callable[[], float] = time.time):
        self.spark, self.sinks, self.clock = spark, sinks, clock
        self.table = StateTable(spark, path, "sink")

    def last_runs(self) -> dict[str, float]:
        return {r["sink"]: r["last_s"] for r in self.table.read().collect()} if self.table.manifest()["runs"] else {}  # one row a sink

    def run(self, batch: DataFrame, n: int) -> None:
        if n <= self.table.manifest()["batch"]:
            return
        last, now = self.last_runs(), self.clock()
        due = [name for name, each in self.sinks.items() if now - last.get(name, float("-inf")) >= each.seconds]
        batch.persist()
        try:
            for name in due:
                self.sinks[name].sink(batch, n, now)
        finally:
            batch.unpersist()
        self.table.commit(self.spark.createDataFrame([(name, float(now)) for name in due], CLOCKS).coalesce(1), n)

    def start(self, rows: DataFrame, checkpoint: str) -> StreamingQuery:
        return rows.writeStream.foreachBatch(self.run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batch_files(path: str, shape: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Sink:
    """A sink that writes what ``shape`` makes of a batch as the folder of its number."""

    def write(batch: DataFrame, n: int, now: float) -> None:
        shape(batch).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return write


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*")


def raw_and_clean(path: str) -> dict[str, Every]:
    """The log of messages as they come, and that without bodies that can't be read: every batch to both."""
    whole = F.try_parse_json(F.col("body").cast("string")).isNotNull()
    return {"raw": Every(0, batch_files(f"{path}/raw")), "clean": Every(0, batch_files(f"{path}/clean", lambda rows: rows.filter(whole)))}
