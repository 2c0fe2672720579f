"""Removal of repeated passages by content-defined chunks of lines.

A text is cut into lines: at line feeds, after punctuation, and after words that end in one of a fixed
class of letter pairs, so that a passage within a long line has lines of its own. Chunks of lines are
content-defined: whether a chunk ends after a line is decided by a polynomial rolling hash over that
line's hash and those of the lines before it (``WINDOW`` in all), so an inserted or deleted line, or a
passage that begins in the middle of one, shifts no cut beyond its window. A chunk that occurs more than
once in the corpus counts as repeated except where it is first: in the rows with the smallest
doc_id that have it, at its first place in the text. Consecutive repeated chunks are removed if they
have at least two lines and ``MIN_CHARS`` characters together, so a short line that many texts share
stays; and at least one of them must have ``ANCHOR_CHARS``, as shorter ones repeat by chance. Everything
else about a text is kept.

Chunks are counted by hash, and lists of their line numbers decide what goes. The texts are then shuffled
once: each is cut into lines again, loses what goes, and gives the bytes of that and of where it is first. If two
different chunks share a hash, the step is repeated with such hashes removing nothing. As the shuffle of the texts
takes most of the disk, what was staged before goes as soon as nothing reads it again, and so do shuffle files.

Defined cases: a null text stays null, an empty one empty; a text whose chunks all go becomes
empty, its row stays; a null doc_id counts as the smallest; rows that repeat a doc_id share its
fate; other columns pass through; column names starting with ``__`` are the operator's own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.llm.shared import drop_staged, freed_shuffles, stage_table, table, text_hash

WINDOW = 2
#: A line ends a chunk with probability 1 / MEAN_LINES.
MEAN_LINES = 2
MIN_CHARS = 64
ANCHOR_CHARS = 24
#: What ends a line, for texts without MARK: as LINE_ENDS, but only looked at where a space or line feed is.
LINE_END = r"[ \n](?<=[.!?,;:|x-zX-Z] |\n)(?<=\n|[.!?,;:|] |[a-hA-H][x-zX-Z] )"
LINE_ENDS = r"(?<=\n)|(?<=[.!?,;:|] )|(?<=[a-hA-H][x-zX-Z] )"
MARK = "\x01"
MODULUS = 2**31 - 1
BASE = 1000003


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("long")


def lines_of(text: Column) -> Column:
    """A text's lines, with their ends. Cutting at a mark set after every end is the faster way, for texts without that mark."""
    marked_ends = F.split(F.regexp_replace(text, LINE_END, "$0" + MARK), MARK, -1)
    return F.when(text.contains(MARK), F.split(text, LINE_ENDS, -1)).otherwise(marked_ends)


def body(lines: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(lines, start + 1, end - start), "")


def chunks(text: Column) -> Column:
    """Array of (start, end: line numbers, body) whose bodies, joined, are the text."""

    def rolling(hashes: Column, at: Column) -> Column:
        terms = [F.coalesce(F.get(hashes, at - 1 - k), F.lit(0)) * pow(BASE, k, MODULUS) for k in range(WINDOW)]
        return sum(terms[1:], terms[0]) % MODULUS

    def cut(lines: Column, hashes: Column) -> Column:
        size = F.size(lines)
        ends = F.filter(F.sequence(F.lit(1), size), lambda at: (at == size) | (rolling(hashes, at) % MEAN_LINES == 0))

        def chunk(ends: Column) -> Column:
            def one(end: Column, k: Column) -> Column:
                start = F.coalesce(F.get(ends, k - 1), F.lit(0))
                return F.struct(start.alias("start"), end.alias("end"), body(lines, start, end).alias("body"))

            return F.transform(ends, one)

        return let(ends, chunk)

    return let(lines_of(text), lambda lines: let(F.transform(lines, line_hash), lambda hashes: cut(lines, hashes)))


def going(found: Column) -> Column:
    """Of an array of (h, start, end, chars, away), a text's chunks that occur elsewhere or twice, those in runs that are long enough, in order.

    Sorting by hash puts an earlier copy just before a chunk.
    """
    total = lambda a, f: F.aggregate(a, F.lit(0), lambda x, y: x + f(y))

    def repeated(sorted_: Column) -> Column:
        kept = F.filter(sorted_, lambda x, k: x["away"] | F.coalesce(F.get(sorted_, k - 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(kept, lambda x: F.struct(x["start"], x["end"], x["chars"], x["h"])))

    def runs(c: Column) -> Column:
        places = F.when(F.size(c) > 0, F.sequence(F.lit(0), F.size(c) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda j: ~F.coalesce(F.get(c, j - 1)["end"] == F.get(c, j)["start"], F.lit(False)))
        return let(starts, lambda s: F.transform(s, lambda at, k: F.slice(c, at + 1, F.coalesce(F.get(s, k + 1), F.size(c)) - at)))

    def goes(run: Column) -> Column:
        lines = F.get(run, F.size(run) - 1)["end"] - F.get(run, F.lit(0))["start"]
        return (lines > 1) & (total(run, lambda x: x["chars"]) >= MIN_CHARS) & F.exists(run, lambda x: x["chars"] >= ANCHOR_CHARS)

    return let(let(F.sort_array(found), repeated), lambda c: F.flatten(F.filter(runs(c), goes)))


def without(lines: Column, gone: Column) -> Column:
    """Lines, joined, without those of the chunks ``gone``, which are in order."""

    def before(x: Column, k: Column) -> Column:
        last = F.coalesce(F.get(gone, k - 1)["end"], F.lit(0))
        return body(lines, last, x["start"])

    tail = body(lines, F.get(gone, F.size(gone) - 1)["end"], F.size(lines))
    return F.concat(F.array_join(F.transform(gone, before), ""), tail)


def chunk_lists(docs: DataFrame) -> DataFrame:
    """(__key, __text, h, end, chars) of each row: its chunks as lists. Staged."""

    def lists(parts: Column) -> Column:
        return F.struct(F.transform(parts, lambda c: F.xxhash64(c["body"])).alias("h"), F.transform(parts, lambda c: c["end"]).alias("end"), F.transform(parts, lambda c: F.length(c["body"])).alias("chars"))

    rows = docs.filter("text is not null").select("__key", "__text", let(chunks(F.col("text")), lists).alias("own"))
    return stage_table(rows.select("__key", "__text", "own.*"), "listed-chunks")


def listed_chunks(lists: DataFrame) -> DataFrame:
    """(__key, __text, h, start, end, chars) of each chunk of ``chunk_lists``."""
    starts = F.concat(F.array(F.lit(0)), F.slice("end", 1, F.size("end") - 1)).alias("start")
    return lists.select("__key", "__text", "h", starts, "end", "chars").select("__key", "__text", F.inline(F.arrays_zip("h", "start", "end", "chars")))


def gathered(shared: DataFrame) -> DataFrame:
    """(__key, __text, found, gone) of ``shared(__key, __text, h, start, end, chars, away)``: a text's shared chunks, and those of them that go. Staged."""
    found = shared.groupBy("__key", "__text").agg(F.collect_set(F.struct("h", "start", "end", "chars", "away")).alias("found"))
    return stage_table(found.withColumn("gone", going(F.col("found"))), "shared-chunks", "zstd")


def decisions(found: DataFrame) -> DataFrame:
    """(__key, __text, __start, __end, __h, __gone) of texts that lose chunks or have a lost one first: lists of the places to compare, in order. Staged."""
    lost = stage_table(found.select(F.explode("gone.h").alias("h")).distinct(), "lost-hashes")
    place = lambda x: F.struct(x["start"], x["end"], x["h"])
    own = found.select("__key", "__text", F.inline(F.transform("gone", place))).withColumn("gone", F.lit(True))
    first = found.select("__key", "__text", F.inline(F.transform(F.filter("found", lambda x: ~x["away"]), place)))
    first = first.join(lost.hint("shuffle_hash"), "h", "left_semi").withColumn("gone", F.lit(False))
    at = F.sort_array(F.collect_list(F.struct("start", "end", "h", "gone")))
    # a place that goes although its text has the chunk first stands twice, as going last
    last = lambda at: F.filter(at, lambda x, k: F.coalesce(F.get(at, k + 1)["start"] != x["start"], F.lit(True)))
    places = own.unionByName(first).groupBy("__key", "__text").agg(at.alias("at")).select("__key", "__text", let(F.col("at"), last).alias("at"))
    # lists of numbers take far fewer bytes in a shuffle than a list of structs
    out = stage_table(places.select("__key", "__text", *[F.col(f"at.{c}").alias(f"__{c}") for c in ("start", "end", "h", "gone")]), "line-decisions", "zstd")
    drop_staged(lost)
    return out


def applied(docs: DataFrame, found: DataFrame, names: list[str]) -> DataFrame:
    """``docs`` with ``text`` cut, removed_chunks, and __bodies: (h, body) of the chunks whose bytes are to be compared. Staged."""
    decided = decisions(found)
    # the decisions grow with the corpus, so they are never broadcast, however small they are
    out = docs.join(decided.hint("merge"), ["__key", "__text"], "left")
    gone = F.filter(F.arrays_zip(F.col("__start").alias("start"), F.col("__end").alias("end"), F.col("__gone").alias("gone")), lambda x: x["gone"])

    def done(lines: Column) -> Column:
        bodies = F.transform(F.arrays_zip("__h", "__start", "__end"), lambda x: F.struct(x["__h"].alias("h"), body(lines, x["__start"], x["__end"]).alias("body")))
        return F.struct(F.when(F.exists("__gone", lambda x: x), let(gone, lambda g: without(lines, g))).alias("text"), bodies.alias("bodies"))

    out = out.withColumn("__out", F.when(F.col("__h").isNotNull(), let(lines_of(F.col("text")), done)))
    text, removed = F.coalesce("__out.text", "text").alias("text"), F.when(F.col("__h").isNotNull(), F.size(F.filter("__gone", lambda x: x))).otherwise(0).cast("long").alias("removed_chunks")
    out = stage_table(out.select(*[text if c == "text" else F.col(c) for c in names], removed, F.col("__out.bodies").alias("__bodies")), "cut-texts", "zstd")
    drop_staged(decided)
    return out


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` with repeated chunks cut from ``text``, and ``removed_chunks`` added."""
    names = [c for c in docs.columns if c != "removed_chunks"]
    docs = docs.select(*names, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("__key"), text_hash(F.col("text")).alias("__text"))
    with freed_shuffles(docs.sparkSession):
        lists = chunk_lists(docs)
        listed = listed_chunks(lists)
        repeated = stage_table(listed.groupBy("h").agg(F.count("*").alias("places"), F.min("__key").alias("first")).filter("places > 1").select("h", "first"), "repeated-chunks")
        found = gathered(listed.join(repeated.hint("shuffle_hash"), "h").withColumn("away", F.col("first") != F.col("__key")).drop("first"))
        drop_staged(lists, repeated)
        out = applied(docs, found, names)
        bodies = out.select(F.inline("__bodies")).groupBy("h", "body").agg(F.lit(1).alias("one"))
        clashing = stage_table(bodies.groupBy("h").agg(F.count("*").alias("bodies")).filter("bodies > 1").select("h"), "clashing-hashes")
        if clashing.limit(1).count():
            drop_staged(out)
            rest = gathered(found.select("__key", "__text", F.inline("found")).join(clashing, "h", "left_anti"))
            out = applied(docs, rest, names)
            drop_staged(rest)
        drop_staged(found, clashing)
    return out.drop("__bodies")


def op2_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "removed_chunks")


OP2_SQL = rf"""
WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '(\n|[.!?,;:|] |[a-hA-H][x-zX-Z] )', '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS line FROM p),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS r FROM l),
b AS (SELECT *, ({" + ".join(f"coalesce(lag(r, {k}) OVER w, 0) * {pow(BASE, k, MODULUS)}" for k in range(WINDOW))}) % {MODULUS} % {MEAN_LINES} = 0 AS cut
      FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM b),
c AS (SELECT doc_id, chunk, count(*) AS n, string_agg(line, '' ORDER BY i) AS body FROM k GROUP BY ALL),
s AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, chunk) > 1 AS repeats FROM c),
r AS (SELECT *, chunk - row_number() OVER (PARTITION BY doc_id, repeats ORDER BY chunk) AS run FROM s),
g AS (SELECT *, repeats AND sum(length(body)) OVER x >= {MIN_CHARS} AND sum(n) OVER x > 1 AND max(length(body)) OVER x >= {ANCHOR_CHARS} AS goes FROM r WINDOW x AS (PARTITION BY doc_id, repeats, run)),
t AS (SELECT doc_id, string_agg(body, '' ORDER BY chunk) FILTER (WHERE NOT goes) AS text, count(*) FILTER (WHERE goes) AS removed FROM g GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text, coalesce(t.removed, 0) AS removed_chunks
FROM documents d LEFT JOIN t USING (doc_id)
"""
