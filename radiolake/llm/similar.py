"""Near duplicates by SimHash, with an exact check, and those beyond its radius by minima.

First the texts' five-word SimHash fingerprints are compared: those that differ in ``RADIUS`` bits or fewer are found in
sharded BK-trees and linked into groups, as ``simhash`` does it. An exact check follows: two texts are linked if the sets
of their shingles have a Jaccard similarity of ``LEAST`` or more, so fingerprints that are near by chance, or by a
shingle that repeats, link nothing.

The radius can't hold 0.8: such pairs differ in up to 14 bits, where shards that make every pair meet
compare nearly all texts with all. So texts also meet in ``TABLES`` tables keyed by ``ROWS`` minima of the
shingles' hashes each, with the same check. Of pairs at exactly 0.8 the minima miss (1 - 0.8 ** ROWS) ** TABLES,
three in a million; of more alike ones, fewer.

Every candidate is confirmed on the sets themselves before it is linked. Only texts that share a
bucket have their sets shuffled; a bucket of more than ``MAX_CELL`` texts is dealt into parts whose
pairs are compared in separate tasks. A task joins what it confirms into local components, so
it emits one link a text, and needs few comparisons in a group of copies.

Defined cases: as in ``simhash`` a null text has no words, texts without words are alike, a text with
fewer words than a shingle is one shingle, and a row without doc_id never displaces one with it. Of
rows equal in doc_id and text one stays; rows that repeat a doc_id with other texts stand for themselves. Columns
that begin with two underscores are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiolake.llm.shared import plain, stage_table, text_hash
from radiolake.llm.simhash import components, dealt_cells, fingerprint_links, fingerprint_of_hashes, shingle_hashes

WORDS = 5
RADIUS = 2
LEAST = (4, 5)
TABLES = 32
ROWS = 5
MAX_CELL = 256
FACTORS = np.random.default_rng(11).integers(0, 2**63, TABLES * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes; of a text without words, one that stands for it."""
    return np.unique(hashes) if len(hashes) else np.zeros(1, np.uint64)


def table_keys(distinct: np.ndarray) -> list[int]:
    """A key for each table: the hash of its minima."""
    least = np.full(len(FACTORS), 2**64 - 1, np.uint64)
    for lo in range(0, len(distinct), 2048):
        least = np.minimum(least, (distinct[lo : lo + 2048, None] * FACTORS).min(0))
    return [xxhash.xxh64_intdigest(m.tobytes(), 100 + i) for i, m in enumerate(least.reshape(TABLES, ROWS))]


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have the least similarity."""
    few, many = sorted((len(a), len(b)))
    if LEAST[1] * few < LEAST[0] * many:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * both >= LEAST[0] * (few + many - both)


def confirmed_links(built: list[tuple[int, np.ndarray]], probes: list[tuple[int, np.ndarray]] | None) -> list[tuple[int, int]]:
    """Links that join all confirmed pairs between built texts, or built ones and probes."""
    groups: list[list[tuple[int, np.ndarray]]] = [] if probes is None else [[x] for x in built]
    out = []
    for x in built if probes is None else probes:
        met = [g for g in groups if any(alike(x[1], y[1]) for y in g)]
        out += [(x[0], g[0][0]) for g in met]
        if probes is None:
            groups = [g for g in groups if not any(g is m for m in met)] + [[*(y for m in met for y in m), x]]
    return [(max(p), min(p)) for p in out]


def prints(docs: DataFrame) -> DataFrame:
    """(doc_id, node, keys, fp) a row of ``docs(doc_id, text)``; node: hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, fps = [], []
            for text in b.column("text"):
                hashes = shingle_hashes(text.as_py(), WORDS)
                keys.append(np.array(table_keys(shingles(hashes)), np.uint64).view(np.int64))
                fps.append(fingerprint_of_hashes(hashes))
            fp = pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("node"), pa.array(keys, pa.list_(pa.int64())), fp], names=["doc_id", "node", "keys", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("node"), "text").mapInArrow(run, "doc_id long, node long, keys array<long>, fp long")


def sets(texts: DataFrame) -> DataFrame:
    """(node, members) a row of ``texts(node, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            members = [shingles(shingle_hashes(t.as_py(), WORDS)).view(np.int64) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(members, pa.list_(pa.int64()))], names=["node", "members"])

    return texts.select("node", "text").mapInArrow(run, "node long, members array<long>")


def simhash_groups(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(node, key) of ``nodes(node, fp)``; key: the group of those whose fingerprints are linked, step by step, within the radius."""
    prints = stage_table(nodes.select("fp").distinct(), "similar-prints")
    links = stage_table(fingerprint_links(prints, radius), "similar-print-links")
    label = F.col("fp")
    if links.limit(1).count():
        nodes = nodes.join(stage_table(components(links), "similar-groups").withColumnsRenamed({"node": "fp", "label": "group"}), "fp", "left")
        label = F.coalesce("group", "fp")
    return nodes.select("node", F.xxhash64(label, F.lit(2)).alias("key"))


def similar_links(docs: DataFrame, nodes: DataFrame, max_cell: int = MAX_CELL) -> DataFrame:
    """Links (a, b), a > b, that connect the nodes of alike texts; ``nodes(node, first, keys, fp)`` of ``docs``."""
    keyed = simhash_groups(nodes).unionByName(nodes.select("node", F.explode("keys").alias("key")))
    # rows that are alone in their bucket go before any set is made
    sizes = stage_table(keyed.groupBy("key").count().filter("count > 1"), "similar-buckets")
    keyed = stage_table(keyed.join(sizes, "key"), "similar-rows")
    wanted = stage_table(keyed.select("node").distinct().join(nodes.select("node", "first"), "node"), "similar-wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("__node"), "text")
    texts = texts.join(wanted, (F.col("__node") == F.col("node")) & F.col("doc_id").eqNullSafe(F.col("first"))).select("node", "text").dropDuplicates(["node"])
    members = stage_table(sets(texts), "similar-sets")
    cells = dealt_cells(keyed, "node", max_cell).join(members, "node")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.select("key", "tree", "by", "probe", "node", "members").repartition(n, "key", "tree", "by").sortWithinPartitions("key", "tree", "by", "probe")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def links(cell: tuple, built: list, probes: list) -> list[tuple[int, int]]:
            return confirmed_links(built, None if cell[1] == cell[2] else probes)

        last, sides = None, ([], [])
        for b in batches:
            out = []
            cols = [b.column(c).to_pylist() for c in ("key", "tree", "by", "probe", "node")]
            for i, (key, tree, by, probe, node) in enumerate(zip(*cols, strict=True)):
                if (key, tree, by) != last:
                    out += links(last, *sides) if last else []
                    last, sides = (key, tree, by), ([], [])
                # a copy, as the batch is not held until its last cell is done
                sides[probe].append((node, np.array(b.column("members")[i].values, np.int64)))
            pairs = np.array(sorted(set(out)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)
        if last:
            pairs = np.array(links(last, *sides), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    return dealt.mapInArrow(search, "a long, b long").distinct()


def drop_similar(docs: DataFrame, max_cell: int = MAX_CELL) -> DataFrame:
    """Keep, of each component of alike texts, the row with the smallest doc_id."""
    docs = plain(docs)
    # first: of rows equal in text, the smallest doc_id, null if none has one
    nodes = stage_table(prints(docs).groupBy("node").agg(F.min("doc_id").alias("first"), F.first("keys").alias("keys"), F.first("fp").alias("fp")), "similar-nodes")
    links = stage_table(similar_links(docs, nodes, max_cell), "similar-links")
    least = nodes.select("node", "first")
    if links.limit(1).count():
        labels = stage_table(components(links).join(least, "node"), "similar-labels")
        best = labels.groupBy("label").agg(F.min(F.struct(F.col("first").isNull().alias("bare"), "first", "node")).alias("best")).select("best.node")
        gone = stage_table(labels.join(best, "node", "left_anti").select("node"), "similar-gone")
        least = least.join(gone, "node", "left_anti")
    # a text that repeats under other ids stays where its id is smallest
    least = stage_table(least, "similar-kept").withColumnsRenamed({"node": "__node", "first": "__first"})
    rows = docs.withColumn("__hash", text_hash(F.col("text")))
    same = (F.col("__hash") == F.col("__node")) & F.col("doc_id").eqNullSafe(F.col("__first"))
    return rows.join(least, same, "left_semi").dropDuplicates(["doc_id", "__hash"]).drop("__hash")
