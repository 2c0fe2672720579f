r"""Resampling towards a target distribution by importance weights of hashed n-grams.

A text's words are runs of letters, digits and anything beyond ASCII, with A-Z lower-cased; its features
are all runs of 1 to ``longest`` consecutive words, joined by one space, and fall into buckets by CRC-32.
An n-gram's CRC is never taken of its characters: each word's CRC is computed once, and as
``crc(a + b) = shift(crc(a), len(b)) ^ crc(b)``, where the shift is a linear map over GF(2), CRCs of
longer runs are composed of those of shorter ones. The maps for 1, 2, 4, ... bytes are four tables of 256
entries each, so a whole batch of texts is shifted by array look-ups.

A bucket's gain says how much more often the target holds it than the corpus does; a document's weight is
the floored mean of its features' gains, and Gumbel noise of its id makes the highest scores a draw without
replacement in proportion to exp(weight / 1000).

Scale: the corpus is reduced to one count a bucket in each task, so what is shuffled and sent to the
driver is buckets, a parameter, times tasks. Ranks come from counts per score: scores are whole numbers between
about -50,000 and 70,000 whatever the corpus is (logs of counts, and noise of 32 bits), so their counts are
a small table, and documents are numbered within their score only. No score can gather more than 1 in 2,000 of
all documents of different ids, as the noise spreads them.

Defined cases: a null or empty text has no features and weight 0; a null id counts as an empty one; rows that repeat an
id draw the same noise and are ranked each; without a target all gains follow from its zero counts; an empty table
gives an empty one. Columns of the input that begin with ``__``, or are named like one that is added (``n_words``,
``n_features``, ``weight``, ``score``, ``rank``), are left out; all others are kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from radiolake.llm.shared import stage_table, table

ADDED = ("n_words", "n_features", "weight", "score", "rank")
#: Reflected polynomial of the CRC-32 of zip files.
POLYNOMIAL = 0xEDB88320
#: Texts are worked on in chunks of about so many bytes; longer ones alone.
CHUNK_BYTES = 4 << 20
#: Words beyond this length take their CRC one by one.
LONG_WORD = 48


@cache
def byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    return t


def mapped(maps: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by its images of each byte's values, of many CRCs."""
    return maps[0][crc & 255] ^ maps[1][crc >> 8 & 255] ^ maps[2][crc >> 16 & 255] ^ maps[3][crc >> 24]


@cache
def shifts() -> list[np.ndarray]:
    """The maps that 1, 2, 4, ... zero bytes behind a CRC's bytes amount to."""
    values = (np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32)[:, None])).astype(np.uint32)
    out = [byte_table()[values & 255] ^ (values >> 8)]
    for _ in range(30):
        out.append(np.array([mapped(out[-1], row) for row in out[-1]]))
    return out


def shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC carried over its own number of following bytes."""
    out, bit = crc.copy(), 0
    while (lengths >> bit).any():
        at = np.flatnonzero(lengths >> bit & 1)
        out[at] = mapped(shifts()[bit], out[at])
        bit += 1
    return out


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the words of lower-cased texts that lie one behind the other between ``bounds``."""
    inside = np.zeros(256, bool)
    inside[0x30:0x3A] = inside[0x61:0x7B] = inside[0x80:] = True
    w = inside[data]
    first, last = w.copy(), w.copy()
    begins = bounds[:-1][bounds[:-1] < len(data)]
    first[1:] &= ~w[:-1]
    first[begins] = w[begins]
    ends = bounds[1:][bounds[1:] > 0] - 1
    last[:-1] &= ~w[1:]
    last[ends] = w[ends]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops, np.searchsorted(bounds, starts, side="right") - 1


def word_crcs(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """CRC-32 of each word, all words a byte at a time."""
    table_, lengths = byte_table(), stops - starts
    out = np.empty(len(starts), np.uint32)
    for i in np.flatnonzero(lengths > LONG_WORD):
        out[i] = zlib.crc32(data[starts[i] : stops[i]])
    short = np.flatnonzero(lengths <= LONG_WORD)
    order = short[np.argsort(-lengths[short].astype(np.int8), kind="stable")]
    at, state = starts[order], np.full(len(order), 0xFFFFFFFF, np.uint32)
    more = np.bincount(lengths[order], minlength=1)[::-1].cumsum()[::-1]
    for j in range(len(more) - 1):
        s = state[: more[j + 1]]
        state[: more[j + 1]] = table_[(s ^ data[at[: more[j + 1]] + j]) & 255] ^ (s >> 8)
    out[order] = ~state
    return out


def ngram_crcs(crcs: np.ndarray, lengths: np.ndarray, text: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(CRCs, text) of all runs of 1, 2, ... ``longest`` words within a text."""
    yield crcs, text
    if longest > 1:
        spaced = shifted(np.full(len(crcs), zlib.crc32(b" "), np.uint32), lengths) ^ crcs  # of a space and the word
        run = crcs
        for n in range(1, longest):
            run = shifted(run[: max(0, len(crcs) - n)], lengths[n:] + 1) ^ spaced[n:]
            same = text[n:] == text[: max(0, len(text) - n)]
            yield run[same], text[n:][same]


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of texts, their bytes with A-Z lower-cased, bounds) of binary texts, without nulls, in bounded pieces."""
    lower = np.arange(256, dtype=np.uint8)
    lower[0x41:0x5B] += 32
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK_BYTES, side="right")) - 1)
        yield end - at, lower[data[bounds[at] : bounds[end]]], bounds[at : end + 1] - bounds[at]
        at = end


def features(texts: pa.Array, longest: int, buckets: int) -> Iterator[tuple[int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """(number of texts, words of each, [(buckets, text of each) of the runs of each length]) of each chunk."""
    for n, data, bounds in chunks(texts):
        starts, stops, text = word_spans(data, bounds)
        runs = ngram_crcs(word_crcs(data, starts, stops), stops - starts, text, longest)
        yield n, np.bincount(text, minlength=n), [((crc % np.uint32(buckets)).astype(np.int64), of) for crc, of in runs]


def as_bytes(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def bucket_counts(docs: DataFrame, target: DataFrame, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each bucket is met in all texts of either table."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for b in batches:
            for side in (0, 1):
                for _, _, runs in features(b.column("text").filter(pc.equal(b.column("side"), side)), longest, buckets):
                    for bucket, _ in runs:
                        total[side] += np.bincount(bucket, minlength=buckets)
        met = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(met, pa.int32()), "s": total[0, met], "t": total[1, met]})

    both = docs.select(as_bytes().alias("text"), F.lit(0).alias("side")).unionAll(target.select(as_bytes().alias("text"), F.lit(1).alias("side")))
    rows = both.mapInArrow(counted, "bucket int, s long, t long").groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).toArrow()  # one row a bucket
    out = np.zeros((2, buckets), np.int64)
    out[:, rows["bucket"].to_numpy()] = rows["s"].to_numpy(), rows["t"].to_numpy()
    return out[0], out[1]


def gains_of(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Each bucket's gain, in thousandths, from its counts in the corpus and in the target."""
    buckets, s_all, t_all = len(s), float(s.sum()), float(t.sum())
    return np.floor(1000 * np.log((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets)))).astype(np.int64)


def scored(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """``docs(doc_id, text, ...)`` with ``n_words``, ``n_features``, ``weight`` and ``score``."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if not c.startswith("__") and c.lower() not in ADDED])
    gains = gains_of(*bucket_counts(docs, target, longest, buckets))

    @F.arrow_udf("n_words long, n_features long, total long")
    def figures(texts: pa.Array) -> pa.Array:
        parts = [np.zeros((3, 0), np.int64)]
        for n, words, runs in features(texts, longest, buckets):
            out = np.zeros((3, n), np.int64)
            out[0] = words
            for bucket, of in runs:
                out[1] += np.bincount(of, minlength=n)
                out[2] += np.bincount(of, weights=gains[bucket], minlength=n).astype(np.int64)  # whole numbers far below 2**53
            parts.append(out)
        return pa.StructArray.from_arrays([pa.array(x) for x in np.hstack(parts)], ["n_words", "n_features", "total"])

    rows = docs.withColumn("__f", figures(as_bytes()))
    weight = F.when(F.col("__f.n_features") > 0, F.floor(F.col("__f.total") / F.col("__f.n_features"))).otherwise(0).cast("long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    return rows.select(*docs.columns, F.col("__f.n_words").alias("n_words"), F.col("__f.n_features").alias("n_features"), weight.alias("weight"), (weight + noise).alias("score"))


def ranked(rows: DataFrame, share: tuple[int, int] = (10, 100), fewest_words: int = 20) -> DataFrame:
    """Scored rows with the ``rank`` of those drawn: of N with enough words the floored share of N with the highest scores, ties to smaller ids."""
    rows = stage_table(rows, "importance")
    counts = rows.filter(F.col("n_words") >= fewest_words).groupBy("score").agg(F.count("*").alias("n")).toArrow()  # bounded by the range of scores
    order = np.argsort(-counts["score"].to_numpy())
    scores, n = counts["score"].to_numpy()[order], counts["n"].to_numpy()[order]
    drawn, before = int(n.sum()) * share[0] // share[1], np.cumsum(n) - n
    hit = before < drawn
    places = rows.sparkSession.createDataFrame(pa.table({"score": pa.array(scores[hit], pa.int64()), "__before": pa.array(before[hit], pa.int64())}))
    whole = rows.join(F.broadcast(places), "score", "left").withColumn("__may", F.coalesce((F.col("n_words") >= fewest_words) & F.col("__before").isNotNull(), F.lit(False)))
    within = Window.partitionBy("score").orderBy("doc_id", "weight", "n_features")
    may = whole.filter("__may").withColumn("rank", F.col("__before") + F.row_number().over(within))
    columns = [F.col(f"`{c}`") for c in rows.columns]
    return may.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")).unionAll(whole.filter("not __may").select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (10, 100), fewest_words: int = 20, longest: int = 2, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """The documents drawn, whole, with their figures and ranks."""
    return ranked(scored(docs, target, longest, buckets, seed), share, fewest_words).filter("rank is not null")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = scored(docs, table(spark, sf_dir, "benchmark"), longest=1, buckets=10_000, seed=2024).drop("text")
    return ranked(rows, (10, 100), 20).select("doc_id", "n_features", "weight", "score", "rank")


#: CRCs of each different word, byte by byte, in place of the composition.
OP11_SQL = r"""
WITH t AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
texts AS (SELECT doc_id, 0 AS side, text FROM documents UNION ALL SELECT item_id, 1, text FROM benchmark),
w AS (SELECT side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts),
x AS (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM w)),
y AS (SELECT w, list_transform(range(length(x) // 2), lambda i: (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * i + 2]) - 1) AS y FROM x),
crc AS (SELECT w, xor(list_reduce(list_prepend(4294967295, y), lambda c, x: xor(t[xor(c & 255, x) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM y, t),
n AS (SELECT side, doc_id, bucket, count(*) AS n FROM w JOIN crc USING (w) GROUP BY ALL),
b AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 0), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0) AS t FROM n GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM b) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM b) + 10000)::DOUBLE)))::BIGINT AS gain FROM b),
d AS (SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM n JOIN g USING (bucket) WHERE side = 0 GROUP BY 1),
f AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM documents LEFT JOIN d USING (doc_id)),
z AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM f),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM z WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * 10 // 100 THEN rank END AS rank FROM z LEFT JOIN r USING (doc_id)
"""
