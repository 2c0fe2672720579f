"""Neighbour graph: who hears whom, reciprocal edges, line segments, reachability, trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from radiolake.functions.mesh import degrees_of, distance_km, has_position


def with_names(edges: DataFrame, nodes: DataFrame, how: str = "left") -> DataFrame:
    """Edges with the far end's short name; a left join names the unknown ``UNK``."""
    names = nodes.select(F.col("num").alias("dst"), "shortname")
    return edges.join(names, "dst", how).withColumn("shortname", F.coalesce("shortname", F.lit("UNK")))


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "snr")


def reciprocal(edges: DataFrame) -> DataFrame:
    """Edges whose opposite is there too; an edge to itself is its own opposite."""
    both = reciprocal_pairs(edges).filter((F.col("a_hears") & F.col("b_hears")) | (F.col("a") == F.col("b")))
    way = lambda src, dst, snr: F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), F.col(snr).alias("snr"))
    ways = F.when(F.col("a") == F.col("b"), F.array(way("a", "b", "a_snr"))).otherwise(F.array(way("a", "b", "a_snr"), way("b", "a", "b_snr")))
    return both.select(F.inline(ways))


def classes(edges: DataFrame) -> DataFrame:
    """(a, b, class) seen from either end: whether a hears b, is heard by it, or both."""
    p = reciprocal_pairs(edges)
    own = F.col("a") == F.col("b")
    kind = lambda hears, heard: F.when(hears & heard, "both").when(hears, "heard").otherwise("heard by")
    forth = F.struct(F.col("a"), F.col("b"), F.when(own, "both").otherwise(kind(F.col("a_hears"), F.col("b_hears"))).alias("class"))
    back = F.struct(F.col("b").alias("a"), F.col("a").alias("b"), kind(F.col("b_hears"), F.col("a_hears")).alias("class"))
    return p.select(F.inline(F.when(own, F.array(forth)).otherwise(F.array(forth, back))))


def segments(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends both have a position, with both places and the distance."""
    placed = nodes.filter(has_position(F.col("lat_i"), F.col("lon_i"))).select("num", degrees_of(F.col("lat_i")).alias("lat"), degrees_of(F.col("lon_i")).alias("lon"))
    a, b = (placed.select(F.col("num").alias(k), F.col("lat").alias(f"{k}_lat"), F.col("lon").alias(f"{k}_lon")) for k in ("src", "dst"))
    out = edges.join(a, "src").join(b, "dst")
    return out.withColumn("km", distance_km(F.col("src_lat"), F.col("src_lon"), F.col("dst_lat"), F.col("dst_lon")))


def reach(edges: DataFrame, start: int, max_depth: int = 10) -> DataFrame:
    """(node, level): nodes within ``max_depth`` hops and their least number of hops.

    One join a level; ``checkpoint`` cuts the lineage into the folder that executors share.
    """
    spark = edges.sparkSession
    front = spark.createDataFrame([(start, 0)], "node long, level int")
    seen = front
    for level in range(1, max_depth + 1):
        front = edges.join(front.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        front = front.join(seen, "node", "left_anti").withColumn("level", F.lit(level)).checkpoint()
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)  # of checkpointed levels
    return seen


def tree(edges: DataFrame, start: str, max_depth: int = 10) -> DataFrame:
    """(path, node, level, expanded): the surroundings of one node of ``edges(src, dst)`` as a tree of paths.

    Level by level, each node that is heard is shown below the one that hears it, the start itself
    never. A node is expanded where it is first met, at the least level and there below the least
    of the nodes that hear it, and elsewhere shown unexpanded; so there are at most as many rows as edges. (A
    depth-first walk, which expands whatever comes first in its order, can place a node deeper.)
    """
    spark = edges.sparkSession
    shape = "path string, node string, level int, expanded boolean"
    front = spark.createDataFrame([(start, start, 0, True)], shape)
    levels, seen = [front], front.select("node")
    for level in range(1, max_depth + 1):
        below = front.filter("expanded").select(F.col("node").alias("src"), F.col("path").alias("__above")).join(edges.select("src", "dst"), "src").filter(F.col("dst") != start)
        first = below.join(seen, F.col("dst") == F.col("node"), "left_anti").groupBy(F.col("dst").alias("__dst")).agg(F.min("src").alias("__src"))
        here = (F.col("dst") == F.col("__dst")) & (F.col("src") == F.col("__src"))
        front = below.join(first, here, "left").select(F.concat_ws(">", "__above", "dst").alias("path"), F.col("dst").alias("node"), F.lit(level).alias("level"), F.col("__dst").isNotNull().alias("expanded")).checkpoint()
        if not front.limit(1).count():
            break
        levels.append(front)
        seen = seen.unionByName(front.filter("expanded").select("node")).checkpoint()
    return reduce(DataFrame.unionByName, levels)


def neighborhood(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, heard, heard_by) of every node: the known nodes it hears, and those that hear it, as lists of ids."""
    listed = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    heard = edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").groupBy("src").agg(listed("dst").alias("heard"))
    by = edges.groupBy("dst").agg(listed("src").alias("heard_by"))
    out = nodes.join(heard, nodes["id"] == F.col("src"), "left").join(by, nodes["id"] == F.col("dst"), "left")
    return out.select(nodes["id"], F.coalesce("heard", F.lit("")).alias("heard"), F.coalesce("heard_by", F.lit("")).alias("heard_by"))


def chunked_lists(rows: DataFrame, key: str, value: str, most: int = 1000) -> DataFrame:
    """(key, chunk, before, values): each key's distinct values, in order, as chunks of at most ``most``.

    ``chunk`` counts from 1 within a key and ``before`` is the number of its values in earlier chunks; the chunks, joined, are the sorted list. Rows are dealt out by
    ranges of key and value together, so a key with a third of all rows is the work of a third of the tasks, and no list
    is longer than a chunk. Nulls are left out.
    """
    pairs = rows.select(key, value).dropna().distinct().repartitionByRange(key, value).sortWithinPartitions(key, value)
    at = F.monotonically_increasing_id()  # the partition above, the place in it below
    cut = pairs.withColumn("__at", at).withColumn("__part", F.shiftright("__at", 33)).withColumn("__block", F.floor(F.col("__at").bitwiseAND((1 << 33) - 1) / most))
    chunks = cut.groupBy(key, "__part", "__block").agg(F.sort_array(F.collect_list(value)).alias("values"))
    order = Window.partitionBy(key).orderBy("__part", "__block")
    before = F.coalesce(F.sum(F.size("values")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return chunks.select(key, F.row_number().over(order).alias("chunk"), before.alias("before"), "values")


def reciprocal_pairs(edges: DataFrame) -> DataFrame:
    """(a, b, a_hears, b_hears, snrs): both directions of each pair of ends in one row, by one grouping."""
    a, b = F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    forth = F.col("src") <= F.col("dst")
    return edges.groupBy(a, b).agg(F.max(F.when(forth, F.col("snr"))).alias("a_snr"), F.max(F.when(~forth, F.col("snr"))).alias("b_snr"), F.max(forth).alias("a_hears"), F.max(~forth).alias("b_hears"))
