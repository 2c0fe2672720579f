"""Personal identifiers: base patterns, and identifiers of other shapes found by their context.

The base finds e-mail and IP addresses, card and phone numbers by their form. These spans seed a
bootstrap. What stands beside a seed is a lexical pattern: the word before it, the two words before
it, the word before it without its punctuation, or the word after it. The same patterns are
looked up for candidates, strings that only resemble an identifier (an address written with "at"
and "dot", a number without its plus sign or with a wrong check digit, an IPv6 address). Patterns
and the identifiers they surround form a graph that is scored in rounds: a pattern is as reliable
as the mean of its instances, a candidate as the mean of its patterns, a seed is certain. A pattern
is trusted if enough different seeds support it, its reliability is high, and most of all places in
the corpus where its words stand are beside an identifier; the last is counted over every word
of every text. Candidates in trusted patterns become spans. Base spans always stay.

All of it is DataFrame expressions. The texts are scanned once for occurrences, which are staged,
and once to count the patterns' words; the graph holds occurrences only. Tables that grow with the
data are joined by staged tables, so the planner broadcasts them only when they are small.

What a candidate can be: an address with a name of up to 64 characters and up to 9 labels of up to 63, as
the standards for addresses allow; eight groups of hexadecimal digits; a number of 7 to 12 or 13 to 19
digits with single separators, up to 40 characters long.

Defined cases: a null text is empty and has no spans; rows equal in doc_id and text share their
spans; a candidate that overlaps a base span, or an earlier candidate of its kind, is none; other
columns are ignored; without seeds nothing is learnt and the base stands alone; a word of any length is
a context as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from radiolake.llm.linededup import let
from radiolake.llm.shared import WORD, stage_table, table, text_hash

KINDS = ("email", "ip", "card", "phone")

# Fixed forms of the base kinds, written so that no text makes matching slow or deep: a match starts
# at the edge of a run of its characters, and runs are taken whole.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[0-9\x20-](?!(?<=[\x20-])(?![0-9])))++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.|$)){4}$"

# Looser forms of candidates.
LIKE_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\[at\]|\(at\)|(?<= )at ) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\[dot\]|\(dot\)|(?<= )dot ) ?[A-Za-z0-9-]{1,63}+){0,8}+"
LIKE_IP = r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
LIKE_NUMBER = r"(?<![0-9A-Za-z+])\(?[0-9][0-9 ().-]{4,38}[0-9](?![0-9A-Za-z])"

ROUNDS = 3
MIN_SEEDS = 5
MIN_RELIABILITY = 0.8
MIN_SPECIFICITY = 0.5
PUNCTUATION = ".,;:!?()[]{}<>\"'=*#|"
#: The last two words of what precedes a place and the first of what follows; words are tried at their start only.
BEFORE = r"(?:(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)[\x20\x09-\x0D]++)?(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)[\x20\x09-\x0D]*+$"
AFTER = r"^[\x20\x09-\x0D]*+([^\x20\x09-\x0D]++)"
BLOCK = 256


def running(lengths: Column) -> Column:
    """Running sums of an array, by blocks, so that a long array takes no quadratic time."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def with_blocks(l: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(l) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(l, b * BLOCK + 1, F.lit(BLOCK))))

        def sums(blocks: Column) -> Column:
            before = F.transform(blocks, lambda _, b: total(F.slice(blocks, F.lit(1), b)))
            return let(before, lambda before: F.transform(l, lambda _, i: F.get(before, F.floor(i / BLOCK).cast("int")) + total(F.slice(l, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1))))

        return let(blocks, sums)

    return let(lengths, with_blocks)


SPAN = "array<struct<s:int,e:int,v:string,ctx:array<string>>>"


def bare(word: Column) -> Column:
    """A word without its punctuation."""
    return F.translate(word, PUNCTUATION, "")


def contexts(before: Column, after: Column) -> Column:
    """Patterns of a place: ``<`` and the word before it, or the last two, ``=`` and the bare word, ``>`` and the word after it."""
    one, two, right = F.lower(F.regexp_extract(before, BEFORE, 2)), F.lower(F.regexp_extract(before, BEFORE, 1)), F.lower(F.regexp_extract(after, AFTER, 1))

    def patterns(w: Column) -> Column:
        said = lambda mark, *words: F.concat(F.lit(mark), F.concat_ws(" ", *words))
        return F.array_compact(F.array(
            F.when(w["one"] != "", said("<", w["one"])), F.when(w["two"] != "", said("<", w["two"], w["one"])),
            F.when((bare(w["one"]) != "") & (bare(w["one"]) != w["one"]), said("=", bare(w["one"]))), F.when(w["right"] != "", said(">", w["right"])),
        ))

    return let(F.struct(one.alias("one"), two.alias("two"), right.alias("right")), patterns)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: start, end (code points), value and contexts.

    The pieces between matches give the places: a match starts after all pieces and matches before.
    """

    def place(found: Column) -> Column:
        def spans(between: Column) -> Column:
            ends = running(F.transform(found, lambda m, i: F.length(F.get(between, i)) + F.length(m)))
            return let(ends, lambda ends: F.transform(found, lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("s"), F.get(ends, i).alias("e"), m.alias("v"), contexts(F.get(between, i), F.get(between, i + 1)).alias("ctx"))))

        return F.when(F.size(found) == 0, F.array().cast(SPAN)).otherwise(let(F.split(text, pattern, -1), spans))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substr(number, F.length(number) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> list[Column]:
    """Valid spans of each of ``KINDS``."""
    empty = F.array().cast(SPAN)
    has_digit = text.rlike("[0-9]")
    n = lambda x: F.length(digits(x["v"]))
    return [
        F.when(text.contains("@"), matches(text, EMAIL)).otherwise(empty),
        F.when(has_digit, F.filter(matches(text, IP), lambda x: x["v"].rlike(OCTETS))).otherwise(empty),
        F.when(has_digit, F.filter(matches(text, CARD), lambda x: F.when(n(x).between(13, 19), luhn(digits(x["v"]))).otherwise(False))).otherwise(empty),
        F.when(text.contains("+"), F.filter(matches(text, PHONE), lambda x: n(x).between(9, 15))).otherwise(empty),
    ]


def candidate_spans(text: Column) -> list[Column]:
    """(kind, spans) of what resembles an identifier."""
    empty = F.array().cast(SPAN)
    has_digit = text.rlike("[0-9]")
    number = F.when(has_digit, matches(text, LIKE_NUMBER)).otherwise(empty)
    email = F.when(text.rlike(r"@|[\[(]at[\])]| at "), F.filter(matches(text, LIKE_EMAIL), lambda x: x["v"].contains("@") | x["v"].rlike(r"\.| dot |[\[(]dot"))).otherwise(empty)
    n = lambda x: F.length(digits(x["v"]))
    return [
        email, F.when(has_digit & text.contains(":"), matches(text, LIKE_IP)).otherwise(empty),
        F.filter(number, lambda x: n(x).between(13, 19)), F.filter(number, lambda x: n(x).between(7, 12)),
    ]


def tagged(kinds: list[Column], seed: bool) -> Column:
    def of_kind(i: int):
        return lambda x: F.struct(F.lit(i).alias("k"), F.lit(seed).alias("seed"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), x["ctx"].alias("ctx"))

    return F.flatten(F.array(*[F.transform(k, of_kind(i)) for i, k in enumerate(kinds)]))


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, key, thash, base, other): spans of a row, each with value and contexts. Staged."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text_hash(F.col("text")).alias("thash"))
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("key"), "thash", tagged(base_spans(F.col("text")), True).alias("base"), tagged(candidate_spans(F.col("text")), False).alias("other"))
    return stage_table(rows, "pii-occurrences")


def free_spans(rows: DataFrame) -> DataFrame:
    """(key, thash, k, seed, s, e, v, ctx): base spans, and candidates that overlap none. Staged.

    In order of their starts, a candidate may not start before the end of any base span so far, nor,
    in the opposite order, end after the start of any so far.
    """
    spans = rows.filter(F.size("base") + F.size("other") > 0).select("key", "thash", F.inline(F.concat("base", "other"))).dropDuplicates(["key", "thash", "k", "seed", "s", "e"])
    text = Window.partitionBy("key", "thash")
    so_far = text.orderBy("s", F.desc("seed")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    from_end = text.orderBy(F.desc("s"), "seed").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = spans.withColumn("__end", F.max(F.when(F.col("seed"), F.col("e"))).over(so_far)).withColumn("__start", F.min(F.when(F.col("seed"), F.col("s"))).over(from_end))
    free = F.col("seed") | ((F.coalesce("__end", F.lit(0)) <= F.col("s")) & (F.coalesce("__start", F.col("e")) >= F.col("e")))
    return stage_table(spans.filter(free).drop("__end", "__start"), "pii-spans")


def graph(spans: DataFrame) -> DataFrame:
    """Distinct edges (k, ctx, instance, seed, places) of the patterns that enough seeds support."""
    instance = F.xxhash64("k", F.lower(F.regexp_replace("v", "[^A-Za-z0-9]+", "")))
    edges = spans.select("k", "seed", instance.alias("instance"), F.explode("ctx").alias("ctx"))
    edges = stage_table(edges.groupBy("k", "ctx", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("places")), "pii-edges")
    support = edges.groupBy("k", "ctx").agg(F.count_if("seed").alias("seeds")).filter(F.col("seeds") >= MIN_SEEDS)
    support = stage_table(support.select("k", "ctx"), "pii-supported")
    return stage_table(edges.join(support, ["k", "ctx"]), "pii-graph")


def scored_patterns(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(k, ctx, reliability, places) after so many rounds over the graph."""
    nodes = edges.withColumn("score", F.col("seed").cast("double"))
    for i in range(rounds):
        patterns = nodes.groupBy("k", "ctx").agg((F.sum("score") / (F.count("*") + 1)).alias("reliability"), F.sum("places").alias("places"))
        patterns = stage_table(patterns, "pii-patterns")
        if i < rounds - 1:
            of_others = edges.filter(~F.col("seed")).join(patterns.select("k", "ctx", "reliability"), ["k", "ctx"]).groupBy("instance").agg(F.avg("reliability").alias("own"))
            of_others = stage_table(of_others, "pii-instances")
            nodes = edges.join(of_others, "instance", "left").withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("own", F.lit(0.0))))
    return patterns


def trusted_patterns(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """Those of high reliability whose words mostly stand beside an identifier, counted over all texts."""
    # before and after, a word has the same places; a bare word those of its forms with punctuation
    words = F.when(F.substring("ctx", 1, 1) == ">", F.concat(F.lit("<"), F.expr("substring(ctx, 2)"))).otherwise(F.col("ctx"))
    good = stage_table(patterns.filter(F.col("reliability") >= MIN_RELIABILITY).withColumn("h", F.xxhash64(words)), "pii-reliable")
    # of several kinds the places add up, of the two sides they don't
    wanted = stage_table(good.groupBy("h", "ctx").agg(F.sum("places").alias("places")), "pii-contexts")
    marked = lambda mark, *x: F.xxhash64(F.concat(F.lit(mark), F.concat_ws(" ", *x)))

    def places(w: Column) -> Column:
        pairs = F.transform(F.when(F.size(w) > 1, F.sequence(F.lit(1), F.size(w) - 1)).otherwise(F.array().cast("array<int>")), lambda i: marked("<", F.get(w, i - 1), F.get(w, i)))
        bare_words = F.filter(F.transform(w, lambda x: F.when(bare(x) != x, marked("=", bare(x)))), lambda h: h.isNotNull())
        return F.concat(F.transform(w, lambda x: marked("<", x)), pairs, bare_words)

    hashes = let(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0)), places)
    counted = docs.select(F.explode(hashes).alias("h")).join(wanted.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.count("*").alias("everywhere"))
    specific = wanted.join(counted, "h").filter(F.col("places") >= MIN_SPECIFICITY * F.col("everywhere")).select("ctx")
    return stage_table(good.join(specific, "ctx", "left_semi").select("k", "ctx"), "pii-trusted")


def find_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, found) a row of ``docs(doc_id, text)``: arrays of (k, s, e), sorted."""
    rows = occurrences(docs)
    spans = free_spans(rows)
    edges = graph(spans)
    of_base = F.transform("base", lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    rows_out = rows.select("doc_id", "key", "thash", F.sort_array(of_base).alias("base"))
    none = F.array().cast("array<struct<k:int,s:int,e:int>>")
    if not edges.filter(~F.col("seed")).limit(1).count():
        return rows_out.select("doc_id", "base", none.alias("found"))
    trusted = trusted_patterns(docs, scored_patterns(edges))
    places = spans.filter(~F.col("seed")).select("key", "thash", "k", "s", "e", F.explode("ctx").alias("ctx"))
    found = places.join(trusted, ["k", "ctx"], "left_semi").groupBy("key", "thash").agg(F.sort_array(F.collect_set(F.struct("k", "s", "e"))).alias("found"))
    return rows_out.join(stage_table(found, "pii-found"), ["key", "thash"], "left").select("doc_id", "base", F.coalesce("found", none).alias("found"))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op5_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda x: x["k"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.sort_array(F.concat("base", "found"))).alias("spans"))
