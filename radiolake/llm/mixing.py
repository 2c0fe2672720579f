"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A document's block is a hash of it, so a source has at most ``BLOCKS`` blocks, evenly filled and
hardly larger than a document where a source is small. A source's blocks are drawn in permuted
order, again from the start in another order when it is wanted more than once, until the words
drawn are as near the target as a block allows; one more block may fill what is then missing. That gives every source an exact quota of draws.
Each draw is cut into as many parts as leave every shard ``PARTS_EACH`` of them or more, a document's part of a draw being
a hash of both, and quotas count parts: they are split among the output shards, each node of a binary tree dealing its quotas to
its two halves by one multivariate-hypergeometric draw, so every leaf holds a fair sample of the
sources and all quotas are met exactly. A shard takes its share of each source's parts, which are
disjoint from the other shards', and shuffles its rows locally.

Only one row a source reaches the driver. The draws (at most ``BLOCKS`` * ``max_repeats`` rows a
source) stay a table, joined to the documents by source and block: a source that holds a third of
all rows is spread over all its blocks. They are broadcast only if their bytes, measured once they
are written, are few. The tree is never written down: a node's split follows from the quotas and the node's number, so each
task walks down it with its rows, through the nodes that these reach. The number of shards follows the words that are taken, unless the caller sets
it, so a shard stays as large however large the corpus is (parts are less than 10**9 in all, the most that one draw may deal with).

A document's words in the mix (``mixed_documents``) are counted from the rows that the tree deals out, not from the plan.

Defined cases: a null text has no words; null is a source of its own, last in order; a source
without words has target 0 and is not drawn; equal rows fall into the same block and part and are drawn
alike; an empty table gives an empty mix. ``mix`` replaces an input column ``shard``; columns that begin with two
underscores are left out; all others are kept, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from radiolake.llm.shared import WORD, broadcast_if_small, plain, stage_table, table, text_hash

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCKS = 1024
PARTS_EACH = 8
#: A shard's words; a mix gets as many shards as its words fill.
SHARD_WORDS = 2_000_000


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS) -> dict[str | None, float]:
    """Words wanted of each source: shares by weight of all words, none above ``most`` times its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free, rest = {}, list(order), float(sum(sizes.values()))
    while free:
        level = rest / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] > most * sizes[s]]
        if not full:
            out |= {s: level * weight[s] for s in free}
            break
        for s in full:
            out[s] = float(most * sizes[s])
            rest -= out[s]
        free = [s for s in free if s not in out]
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int = 0) -> np.ndarray:
    """(shards, sources) draws of each source in each shard; columns sum to ``quotas``."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(node: int, lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        left = np.random.default_rng([seed, node]).multivariate_hypergeometric(have, int(have.sum()) * (mid - lo) // (hi - lo), method="marginals")
        split(2 * node, lo, mid, left)
        split(2 * node + 1, mid, hi, have - left)

    split(1, 0, shards, np.asarray(quotas, np.int64))
    return out


def leaves(quotas: np.ndarray, shards: int, seed: int, source: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The shard of each (source, place among its quota), by the same tree as ``split_quotas``, through the nodes that are reached."""
    out = np.zeros(len(place), np.int64)
    todo = [(1, 0, shards, np.asarray(quotas, np.int64), np.arange(len(place)), place)]
    while todo:
        node, lo, hi, have, rows, at = todo.pop()
        if not len(rows):
            continue
        if hi - lo == 1:
            out[rows] = lo
            continue
        mid = (lo + hi) // 2
        left = np.random.default_rng([seed, node]).multivariate_hypergeometric(have, int(have.sum()) * (mid - lo) // (hi - lo), method="marginals")
        here = at < left[source[rows]]
        todo.append((2 * node, lo, mid, left, rows[here], at[here]))
        todo.append((2 * node + 1, mid, hi, have - left, rows[~here], (at - left[source[rows]])[~here]))
    return out


def parts_of(draws: int, shards: int) -> int:
    """Into how many parts a draw is cut: a power of two."""
    wanted, most = PARTS_EACH * shards / max(1, draws), 999_999_999 // max(1, draws)
    return 1 << max(0, min(math.ceil(math.log2(max(1, wanted))), most.bit_length() - 1))


@dataclass
class Mix:
    docs: DataFrame  # the input with __size, __source_size, __target, __block and __draws, an array of numbers
    shards: int
    parts: int
    quotas: list[tuple[str | None, int]]  # parts drawn of each source


def planned_mix(docs: DataFrame, shards: int | None = None, seed: int = 0, shard_words: int = SHARD_WORDS) -> Mix:
    spark, docs = docs.sparkSession, plain(docs)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    docs = docs.withColumn("__size", size).withColumn("__block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", text_hash(F.col("text"))), F.lit(BLOCKS)).cast("int"))
    blocks = stage_table(docs.groupBy("source", "__block").agg(F.sum("__size").alias("words")), "mix-blocks")
    sizes = {r[0]: r[1] for r in blocks.groupBy("source").agg(F.sum("words")).collect()}  # one row a source
    wanted = targets(sizes)
    shards = shards or max(1, math.ceil(sum(wanted.values()) / shard_words))
    per_source = spark.createDataFrame([(s, sizes[s], wanted[s]) for s in sizes], "__source string, __source_size long, __target double")
    same_source = F.col("source").eqNullSafe(F.col("__source"))
    blocks = blocks.join(per_source, same_source).drop("__source").filter("__source_size > 0")
    rounds = blocks.withColumn("round", F.explode(F.sequence(F.lit(0), F.floor(F.col("__target") / F.col("__source_size")).cast("int"))))
    order = Window.partitionBy("source").orderBy("round", F.xxhash64(F.lit(seed), "round", "__block"), "__block")
    before = F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words")
    rounds = rounds.filter("words > 0").withColumn("draw", F.row_number().over(order)).withColumn("drawn", before + F.col("words") / 2 <= F.col("__target"))
    # of the blocks that the last round leaves, the one that fits best into what is still missing
    missing = F.col("__target") - F.sum(F.when(F.col("drawn"), F.col("words")).otherwise(0)).over(Window.partitionBy("source"))
    rounds = rounds.withColumn("missing", missing).withColumn("off", F.abs(F.col("missing") - F.col("words")))
    best = F.row_number().over(Window.partitionBy("source").orderBy("drawn", "off", "draw")) == 1
    draws = rounds.withColumn("best", best).filter("drawn or (best and off < abs(missing))")
    draws = stage_table(draws.withColumn("draw", F.row_number().over(Window.partitionBy("source").orderBy("draw")) - 1).select("source", "__block", "draw"), "mix-draws")
    counted = sorted(((r[0], r[1]) for r in draws.groupBy("source").count().collect()), key=lambda r: (r[0] is None, r[0] or ""))  # one row a source
    parts = parts_of(sum(n for _, n in counted), shards)
    dealt = draws.groupBy("source", "__block").agg(F.sort_array(F.collect_list("draw")).alias("__draws"))
    dealt = broadcast_if_small(stage_table(dealt.withColumnsRenamed({"source": "__source", "__block": "__drawn"}), "mix-dealt"))
    docs = docs.join(dealt, same_source & (F.col("__block") == F.col("__drawn")), "left").drop("__source", "__drawn")
    per_source = broadcast_if_small(stage_table(per_source, "mix-sources"))
    docs = docs.join(per_source, same_source, "left").drop("__source")
    return Mix(docs.withColumn("__draws", F.coalesce("__draws", F.array().cast("array<int>"))), shards, parts, [(s, n * parts) for s, n in counted])


def plan_mix(docs: DataFrame, shards: int | None = None, seed: int = 0, shard_words: int = SHARD_WORDS) -> Mix:
    """The plan with ``size``, ``source_size``, ``target`` and ``draws`` in place of input columns of these names."""
    public = {"__size": "size", "__source_size": "source_size", "__target": "target", "__draws": "draws"}
    planned = planned_mix(docs.drop(*public.values()), shards, seed, shard_words)
    return replace(planned, docs=planned.docs.withColumnsRenamed(public))


def dealt_rows(planned: Mix, columns: list, seed: int = 0, all_rows: bool = False) -> DataFrame:
    """``columns`` of the plan's rows, each row as often as it is drawn, with ``__draw`` and ``shard``, to which the tree deals it; with ``all_rows`` those that aren't drawn too, with nulls."""
    codes, quotas, n = {s: i for i, (s, _) in enumerate(planned.quotas)}, np.array([q for _, q in planned.quotas], np.int64), planned.shards

    @F.pandas_udf("long")
    def shard_of(source: pd.Series, place: pd.Series) -> pd.Series:
        drawn = place.notna().to_numpy()
        at = np.array([codes[s if isinstance(s, str) else None] for s in source[drawn]], np.int64)
        out = pd.Series(pd.NA, index=place.index, dtype="Int64")
        out[drawn] = leaves(quotas, n, seed, at, place[drawn].to_numpy(np.int64))
        return out

    part = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "__hash", "__draw"), F.lit(planned.parts))
    rows = planned.docs.withColumn("__hash", text_hash(F.col("text"))).withColumn("__draw", (F.explode_outer if all_rows else F.explode)("__draws"))
    rows = rows.select(*columns, F.col("source").cast("string").alias("__from"), (F.col("__draw").cast("long") * planned.parts + part).alias("__place"), "__draw")
    return rows.withColumn("shard", shard_of(F.col("__from"), F.col("__place")).cast("int")).drop("__from", "__place")


def mix(docs: DataFrame, shards: int | None = None, seed: int = 0, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The mixed rows, each as often as it is drawn, with ``shard``; a shard is one partition, shuffled inside."""
    planned = planned_mix(docs.drop("shard"), shards, seed, shard_words)
    names = [c for c in plain(docs).columns if c != "shard"]
    rows = dealt_rows(planned, [F.col(f"`{c}`") for c in names], seed).withColumn("__order", F.xxhash64(F.lit(seed), "doc_id", "__draw"))
    return rows.repartitionById(planned.shards, "shard").sortWithinPartitions("shard", "__order").select(*[F.col(f"`{c}`") for c in names], "shard")


def mixed_documents(planned: Mix, seed: int = 0) -> DataFrame:
    """One row a document: its size, its source's size and target, and ``shards``, those that the tree deals it to, each as often as it is there."""
    about = [F.col("doc_id"), F.col("source"), F.col("__hash"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.size("__draws").alias("__times")]
    rows = dealt_rows(planned, about, seed, all_rows=True)
    # equal documents are drawn alike, so a draw and its shard are one entry, and the rows are as many as the copies times the draws
    dealt = F.collect_set(F.when(F.col("shard").isNotNull(), F.struct("__draw", "shard")))
    counted = rows.groupBy(*[c for c in rows.columns if c not in ("__draw", "shard")]).agg(F.transform(F.sort_array(dealt), lambda x: x["shard"]).alias("shards"), F.count("*").alias("__rows"))
    copies = F.floor(F.col("__rows") / F.greatest(F.lit(1), "__times")).cast("int")
    return counted.withColumn("__copy", F.explode(F.sequence(F.lit(1), copies))).select("doc_id", "source", "size", "source_size", "target", "shards")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixed_documents(planned_mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))
    return mixed.select(
        "doc_id", "size", F.coalesce("source_size", F.lit(0)).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), (F.col("size") * F.size("shards")).alias("taken"), "shards"
    )
