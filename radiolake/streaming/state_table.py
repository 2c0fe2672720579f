"""A table of keyed state that a stream changes, as levels of runs under a manifest.

Each batch writes the keys that it changed as a run. Once a level holds ``FAN`` runs they are merged into one of the next level, the newest row of
each key; so a key is rewritten a logarithmic number of times, and reading the state reads at most ``FAN - 1`` runs a level and costs
the live keys, not the history. Which runs the state consists of is said by a manifest: a new, numbered file, written beside the others and put in its
place by one rename. A reader sees the old state or the new one; a writer that dies in between has changed nothing, and what it wrote is
removed later. A batch that runs again after it was committed changes nothing. One stream writes a table; a second writer finds its number taken and fails.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FAN = 8
#: Manifests whose runs are kept for readers that began with them.
KEPT = 3


class StateTable:
    def __init__(self, spark: SparkSession, path: str, key: str, fan: int = FAN):
        self.spark, self.path, self.key, self.fan = spark, path.rstrip("/"), key, fan
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.files = self.hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, *parts: str):
        return self.hadoop.Path("/".join([self.path, *parts]))

    def names(self, folder: str) -> list[str]:
        if not self.files.exists(self.at(folder)):
            return []
        return sorted(f.getPath().getName() for f in self.files.listStatus(self.at(folder)))

    def manifests(self) -> list[str]:
        return [n for n in self.names("manifests") if n.endswith(".json")]

    def manifest(self, name: str | None = None) -> dict:
        """The newest manifest: the last batch, and the runs as (name, level), the oldest first."""
        name = name or (self.manifests() or [None])[-1]
        if name is None:
            return {"batch": -1, "runs": []}
        stream = self.files.open(self.at("manifests", name))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def swap(self, manifest: dict) -> None:
        """Put a new manifest in place, by one rename to a name that isn't there yet."""
        number = int(self.manifests()[-1].removesuffix(".json")) + 1 if self.manifests() else 0
        made, place = self.at("manifests", f"_{uuid.uuid4().hex}"), self.at("manifests", f"{number:012d}.json")
        out = self.files.create(made)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self.files.exists(place) or not self.files.rename(made, place):
            raise RuntimeError(f"{place} is there already: another stream writes this table")

    def run_of(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/runs/{name}")
        return name

    def rows(self, runs: list[str]) -> DataFrame:
        """The newest row of each key of some runs."""
        all_ = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [self.spark.read.parquet(f"{self.path}/runs/{r}") for r in runs])
        newest = Window.partitionBy(self.key).orderBy(F.desc("__batch"))
        return all_.withColumn("__rank", F.row_number().over(newest)).filter("__rank = 1").drop("__rank")

    def commit(self, changed: DataFrame, batch: int) -> None:
        """Write the keys that a batch changed, one row each, and merge the levels that are full."""
        now = self.manifest()
        if batch <= now["batch"]:
            return
        runs = [tuple(r) for r in now["runs"]] + [(self.run_of(changed.withColumn("__batch", F.lit(batch).cast("long"))), 0)]
        level = 0
        while len(full := [r for r, at in runs if at == level]) >= self.fan:
            kept = [(r, at) for r, at in runs if at != level]
            merged = (self.run_of(self.rows(full)), level + 1)
            older = [r for r in kept if r[1] > level]
            runs, level = [*older, merged, *(r for r in kept if r[1] < level)], level + 1
        self.swap({"batch": batch, "runs": runs})
        self.clean()

    def clean(self) -> None:
        """Remove what the newest manifests don't hold: merged runs, and those of writers that died."""
        names = self.manifests()
        used = {r for n in names[-KEPT:] for r, _ in self.manifest(n)["runs"]}
        for name in names[:-KEPT]:
            self.files.delete(self.at("manifests", name), False)
        for run in self.names("runs"):
            if run not in used:
                self.files.delete(self.at("runs", run), True)

    def read(self) -> DataFrame:
        """The state: the newest row of each key."""
        runs = [r for r, _ in self.manifest()["runs"]]
        if not runs:
            raise ValueError(f"{self.path} holds no state yet")
        return self.rows(runs).drop("__batch")
