"""Reproducible shuffle of a table into shards by a Feistel permutation of its row numbers.

Every row gets a global number, the permutation sends the number to a position, and the position
gives shard and slot by one division. Nothing but the number is needed to compute a row's place,
so the place of any row can be found again without the data.

Row numbers do not depend on how the input is laid out in files or partitions: a row's bucket is
a hash of its key columns, the number of rows in each of a fixed number of buckets gives the
bucket's first number, and rows are ordered within their bucket. Buckets are the only groups
sorted, so no task sees more than its share.

Defined cases: null key values hash and sort like any other value; rows that are equal in every
key column are interchangeable and share the bucket's consecutive numbers; an empty table stays
empty; input columns named like an output column are replaced, and those that begin with two underscores are left out
(but for the keys).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from radiolake.llm.shared import crc32_text, plain, table, text_hash

#: Groups among which rows are numbered; bounds the only table that is broadcast.
BUCKETS = 4096
SHARDS = 24


def domain(n: int) -> tuple[int, int]:
    """Sides (a, b) of the permuted grid: a * b >= n, with as few unused cells as can be found.

    A walk from a used cell meets each unused cell at most once, so their number bounds its length.
    """
    root = max(1, math.isqrt(n))
    sides = range(max(1, min(root, 1000)), min(root, 5000) + 1)
    a = min(sides, key=lambda a: (-(-n // a) * a - n, -a))
    return a, max(1, -(-n // a))


def permuted(x: Column, n: int, seed: int = 0, rounds: int = 6) -> Column:
    """Where the permutation of 0..n-1 chosen by ``seed`` sends ``x``."""
    a, b = domain(n)

    def turned(x: Column) -> Column:
        def step(cell: Column, i: Column) -> Column:
            left, right = cell["l"], cell["r"]
            moved_left = (left + F.pmod(F.xxhash64(right, i, F.lit(seed)), F.lit(a))) % a
            moved_right = (right + F.pmod(F.xxhash64(left, i, F.lit(seed)), F.lit(b))) % b
            odd = i % 2 == 1
            return F.struct(F.when(odd, moved_left).otherwise(left).alias("l"), F.when(odd, right).otherwise(moved_right).alias("r"))

        rest = x % b
        cell = F.struct(F.floor((x - rest) / b).cast("long").alias("l"), rest.alias("r"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), cell, step, lambda c: c["l"] * b + c["r"])

    unused = a * b - n
    if not unused:
        return turned(x)
    walk = F.sequence(F.lit(1), F.lit(unused))
    return F.aggregate(walk, turned(x), lambda y, _: F.when(y < n, y).otherwise(turned(y)))


def number_rows(df: DataFrame, keys: Sequence[Column], name: str = "row_number", buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """Add the row's global number, from 0, in the order of (bucket, hash, keys); also the row count."""
    df = df.drop("__bucket", "__first", "__rank").withColumn("__hash", F.xxhash64(*keys)).withColumn("__bucket", F.pmod("__hash", F.lit(buckets)).cast("int"))
    counts = sorted((r[0], r[1]) for r in df.groupBy("__bucket").count().collect())  # one row a bucket at most
    first, total = [], 0
    for bucket, n in counts:
        first.append((bucket, total))
        total += n
    firsts = df.sparkSession.createDataFrame(first, "__bucket int, __first long")
    within = Window.partitionBy("__bucket").orderBy("__hash", *keys)
    df = df.withColumn("__rank", F.row_number().over(within)).join(F.broadcast(firsts), "__bucket")
    return df.withColumn(name, F.col("__first") + F.col("__rank") - 1).drop("__hash", "__bucket", "__first", "__rank"), total


def shard_rows(df: DataFrame, shards: int, keys: Sequence[Column], seed: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """Add ``shard`` (0..shards-1; sizes at most one apart) and ``slot`` (gapless from 0 in each).

    A task sorts a bucket's rows, so ``buckets`` should grow with the table; it changes the numbers.
    """
    df, n = number_rows(df.drop("shard", "slot"), keys, "__number", buckets)
    at = permuted(F.col("__number"), n, seed)
    df = df.withColumn("__at", at)
    return plain(df.withColumn("shard", (F.col("__at") % shards).cast("int")).withColumn("slot", F.expr(f"__at div {shards}")))


def op3_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).withColumn("text_crc32", crc32_text(F.col("text"))).withColumn("__text", text_hash(F.col("text")))
    out = shard_rows(docs, SHARDS, [F.col("doc_id"), F.col("__text")])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
