"""SimHash fingerprints, linked within a Hamming radius through sharded BK-trees.

Two fingerprints that differ in at most two bits agree in one of three blocks of 21, 21 and 22 bits, so they meet in one of the
three shards of either, if a shard is named by a block, or by the leading bits of one. As many bits are taken as leave some
hundreds of fingerprints a shard (``SHARD``), chosen from how many there are; a shorter name loses no link. (Where 21 bits
leave more, beyond 500 million fingerprints, shards are named by the leading bits of pairs of four 16-bit bands, of which two agree.)
A BK-tree (children keyed by their integer distance to the parent) is built for each shard, is
shipped only to the tasks whose fingerprints belong there, and a search follows only the edges
whose key is within the radius. A tree's size is bounded by ``MAX_TREE``: a larger shard is dealt
into several trees, each probed by every part of that shard, so no link is lost and no task holds
a whole shard. (Trees are routed by key rather than broadcast to all tasks: their total size grows
with the data.)

A shard's task joins what it finds into local components and emits one link a fingerprint, never
the pairs. Links are then joined over all shards by label propagation with pointer jumping on
staged tables, so nothing of the corpus passes through the driver.

Defined cases: a null text has no words; a text without words has fingerprint zero, linked like
any other; a text with fewer words than a shingle is one shingle; equal texts, and repeated rows,
share a component; a row without doc_id takes part but never names a component unless its whole
component has no doc_id (then it is null); other columns are kept by ``near_duplicates`` and
``fingerprint``/``component_id`` replace input columns of that name; columns that begin with two underscores are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from radiolake.llm.shared import drop_staged, plain, stage_table, table

BANDS = 4
BLOCKS = ((0, 21), (21, 21), (42, 22))
SHARD, MAX_TREE = 256, 4096
PAIR_BITS = 32


def shingle_hashes(text: str | None, words_each: int = 3) -> np.ndarray:
    """Unsigned 64-bit hashes of a text's word shingles, repeats included."""
    words = (text or "").encode().lower().split()  # of bytes: only A-Z change, only ASCII white space splits
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    ends = list(accumulate(len(w) + 1 for w in words))
    hashes = b"".join([digest(joined[a : b - 1], 42) for a, b in zip([0, *ends], ends[words_each - 1 :] or ends[-1:], strict=False)])
    return np.frombuffer(hashes, ">u8").astype(np.uint64)


def fingerprint_of_hashes(hashes: np.ndarray) -> int:
    """Unsigned 64-bit SimHash: the bits that most of the hashes have."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(hashes)).tobytes())


def fingerprint_of(text: str | None, words_each: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles, repeats included."""
    return fingerprint_of_hashes(shingle_hashes(text, words_each))


@F.pandas_udf(T.LongType())
def fingerprint3(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint_of(x) for x in texts], np.uint64).view(np.int64))


class BKTree:
    """Integers under Hamming distance."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, value: int, radius: int) -> list[int]:
        """Places of the stored values at most ``radius`` bits away."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            todo += [child for key, child in self.children[at].items() if d - radius <= key <= d + radius]
        return found

    def add(self, value: int) -> None:
        at, new = 0, len(self.values)
        self.values.append(value)
        self.children.append({})
        while new:
            d = (self.values[at] ^ value).bit_count()
            if (below := self.children[at].get(d)) is None:
                self.children[at][d] = new
                return
            at = below


def local_links(built: list[int], probes: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Links (value, smaller member of its local component) between built values, or built and probes."""
    tree, parent = BKTree(), {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(x: int, y: int) -> None:
        x, y = top(x), top(y)
        parent[max(x, y)] = min(x, y)

    for x in built:
        if probes is None:
            for at in tree.within(x, radius):
                join(x, tree.values[at])
        tree.add(x)
    for x in probes or ():
        for at in tree.within(x, radius):
            join(x, tree.values[at])
    return [(x, top(x)) for x in parent if top(x) != x]


def shard_bits(n: int) -> int:
    """Bits of a shard's name that leave ``SHARD`` to twice as many of ``n`` evenly spread fingerprints in a shard."""
    return min(PAIR_BITS, max(0, (n // SHARD).bit_length() - 1))


def shard_keys(fp: Column, bits: int) -> Column:
    """A fingerprint's shards: (which blocks, their leading bits), as one long each."""

    def named(k: int, value: Column) -> Column:
        return F.shiftleft(F.lit(k).cast("long"), PAIR_BITS).bitwiseOR(value)

    if bits <= min(width for _, width in BLOCKS):
        return F.array(*[named(k, F.shiftrightunsigned(fp, at + width - bits).bitwiseAND((1 << bits) - 1)) for k, (at, width) in enumerate(BLOCKS)])
    band = [F.shiftrightunsigned(fp, 16 * i).bitwiseAND(0xFFFF) for i in range(BANDS)]
    return F.array(*[named(k, F.shiftrightunsigned(F.shiftleft(band[i], 16).bitwiseOR(band[j]), PAIR_BITS - bits)) for k, (i, j) in enumerate(combinations(range(BANDS), 2))])


def dealt_cells(keyed: DataFrame, name: str, most: int) -> DataFrame:
    """Rows (key, name, tree, by, probe): each shard of ``keyed(key, name)`` dealt into parts of about ``most``.

    Part p of a shard is built for cells (p, q >= p) and probes cells (q < p, p).
    """
    large = stage_table(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > most), "simhash-large")
    parts = F.coalesce(F.ceil(F.col("n") / most), F.lit(1)).cast("int")
    keyed = keyed.select("key", name).join(large, "key", "left").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64(name, F.lit(1)), F.col("parts")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least(q, F.col("part")).alias("tree"), F.greatest(q, F.col("part")).alias("by"), (q < F.col("part")).alias("probe")))
    return keyed.select("key", name, F.inline(cells))


def fingerprint_links(fps: DataFrame, radius: int = 2, max_tree: int = MAX_TREE) -> DataFrame:
    """Links (a, b), a > b, that connect the distinct fingerprints ``fps(fp)`` within ``radius`` <= 2."""
    if radius > 2:
        raise ValueError("three blocks reach two differing bits at most")
    keyed = fps.select("fp", F.explode(shard_keys(F.col("fp"), shard_bits(fps.count()))).alias("key"))
    cells = dealt_cells(keyed, "fp", max_tree)
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartition(n, "key", "tree", "by").sortWithinPartitions("key", "tree", "by", "probe")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def links(cols: dict[str, np.ndarray], cuts: np.ndarray) -> pa.RecordBatch:
            out = []
            for lo, hi in cuts[np.diff(cuts, axis=1)[:, 0] > 1]:
                fp, probe = cols["fp"][lo:hi].tolist(), cols["probe"][lo:hi]
                split = hi - lo - int(probe.sum())
                cell_of_one = cols["tree"][lo] == cols["by"][lo]
                out += local_links([x & (2**64 - 1) for x in fp[:split]], None if cell_of_one else [x & (2**64 - 1) for x in fp[split:]], radius)
            a = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], schema=schema)

        for b in batches:
            cols = {n: b.column(n).to_numpy(zero_copy_only=False) for n in b.schema.names}
            if rest:
                cols = {n: np.concatenate([rest[n], v]) for n, v in cols.items()}
            if not len(cols["fp"]):
                continue
            new = np.flatnonzero((np.diff(cols["key"]) != 0) | (np.diff(cols["tree"]) != 0) | (np.diff(cols["by"]) != 0)) + 1
            edges = np.concatenate([[0], new])
            yield links(cols, np.stack([edges[:-1], edges[1:]], 1))
            rest = {n: v[edges[-1] :] for n, v in cols.items()}
        if rest:
            yield links(rest, np.array([[0, len(rest["fp"])]]))

    return dealt.select("key", "tree", "by", "probe", "fp").mapInArrow(search, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links(a, b)``; label: the least node of its component.

    Each round points every node to the least of itself and its neighbours, and then to where that one
    points; links are drawn anew between the nodes pointed to. At least half of the nodes that still
    have links go with each round, so the rounds grow with the logarithm of their number, and the links
    shrink. Each round is staged. At the end the pointers are followed round by round.
    """
    edges, rounds = stage_table(links.select("a", "b").filter("a <> b").distinct(), "links"), []
    alone = links.filter("a = b").select(F.col("a").alias("node")).distinct()
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage_table(both.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("node"), F.least("a", "near").alias("label")), "near")
        above = least.select(F.col("node").alias("label"), F.col("label").alias("above"))
        to = stage_table(least.join(above, "label").select("node", F.col("above").alias("label")), "labels")
        ends = edges.join(to.select(F.col("node").alias("a"), F.col("label").alias("new_a")), "a").join(to.select(F.col("node").alias("b"), F.col("label").alias("new_b")), "b")
        drawn = stage_table(ends.filter("new_a <> new_b").select(F.greatest("new_a", "new_b").alias("a"), F.least("new_a", "new_b").alias("b")).distinct(), "links")
        drop_staged(edges, least)
        rounds.append(to)
        edges = drawn
    if not rounds:
        return alone.withColumn("label", F.col("node"))
    labels = rounds[0]
    for to in rounds[1:]:
        labels = labels.join(to.select(F.col("node").alias("label"), F.col("label").alias("above")), "label", "left").select("node", F.coalesce("above", "label").alias("label"))
    return labels.unionByName(alone.join(labels, "node", "left_anti").withColumn("label", F.col("node"))) if alone.limit(1).count() else labels


def link_documents(docs: DataFrame, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id, label) a row of ``docs(doc_id, text)``; fp as a signed long, label: a fingerprint of its component."""
    prints = stage_table(docs.select("doc_id", fingerprint3("text").alias("fp")), "prints")
    groups = stage_table(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "groups")
    links = stage_table(fingerprint_links(groups.select("fp"), radius), "fp-links")
    named = groups.filter("n > 1").select("fp", F.col("first").alias("component_id"), F.col("fp").alias("label"))
    if links.limit(1).count():
        labels = stage_table(components(links).join(groups.select(F.col("fp").alias("node"), "first"), "node"), "labelled")
        least = stage_table(labels.groupBy("label").agg(F.min("first").alias("component_id")), "least")
        linked = stage_table(labels.join(least, "label").select(F.col("node").alias("fp"), "component_id", "label"), "linked")
        named = named.join(linked, "fp", "left_anti").unionByName(linked)
    named = stage_table(named, "named").withColumn("__named", F.lit(True))
    component = F.when(F.col("__named"), F.col("component_id")).otherwise(F.col("doc_id"))
    return prints.join(named, "fp", "left").select("doc_id", "fp", component.alias("component_id"), F.coalesce("label", "fp").alias("label"))


def near_duplicates(docs: DataFrame, radius: int = 2) -> DataFrame:
    """Add ``fingerprint`` (16 hex digits) and ``component_id`` to ``docs(doc_id, text)``, row by row."""
    out = link_documents(docs, radius)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = 2) -> DataFrame:
    """Keep, of each component, one row with the smallest doc_id.

    Rows that repeat a doc_id with texts of other components stand for themselves; a component
    without any doc_id keeps one row.
    """
    docs = plain(docs)
    kept = link_documents(docs, radius).filter("doc_id <=> component_id").groupBy("label", "doc_id").agg(F.min("fp").alias("fp"))
    kept = stage_table(kept, "kept").withColumnsRenamed({"doc_id": "__id", "fp": "__kept"})
    rows = docs.withColumn("__fp", fingerprint3("text"))
    same = (F.col("__fp") == F.col("__kept")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    return rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", "__fp"]).drop("__fp")


def op10_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
