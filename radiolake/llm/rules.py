"""Quality rules: plain counts, and how far a text's histograms are from those of its language.

For each language, the shares of character classes and of its ``COMMON`` most frequent words are
counted over all documents. A text's own shares are held against them by the Jensen-Shannon
distance (square root of the divergence to base 2). A text of few words tells little, so each
distance has a minimum length, and the word distance an allowance for sampling noise that falls
with the number of words.

Everything is a DataFrame expression. The references reach the driver: ``COMMON`` words and one
row of classes a language, a size that does not grow with the documents; they are looked up in a
constant hash table, so each word of a text costs one probe.

Defined cases: a null or empty text has no words and fails the base rules; a null language is a
language of its own (the same as an empty one); a language seen in no document cannot occur; lines
are what ``\\n`` separates; other columns are ignored, repeated rows judged alike.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from radiolake.llm.linededup import let
from radiolake.llm.shared import WORD, table

#: Character classes, removed from a text one after the other; what is left is the last class.
CLASSES = ("[a-z]+", r"[\x20\x09-\x0D]+", "[A-Z]+", "[0-9]+", "[.,;:?()'\"-]+", r"[#*$%&|<>!@^~=+_{}\[\]\\/`]+")
SYMBOLS = "[#*$%&|<>]+"
COMMON = 64
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MIN_CLASS_WORDS = 50
MAX_CLASS_DISTANCE = 0.3
MIN_WORD_WORDS = 50
MAX_WORD_DIVERGENCE = 0.08


def class_counts(text: Column) -> Column:
    """(n: characters of each class, symbols: how many are one of ``#*$%&|<>``)."""

    def removed(left: Column, i: int, lengths: list[Column], symbols: Column) -> Column:
        lengths = [*lengths, F.length(left).cast("long")]
        if i == 2:  # neither letters nor white space are symbols
            symbols = lengths[-1] - F.length(F.regexp_replace(left, SYMBOLS, ""))
        if i == len(CLASSES):
            counts = [x - y for x, y in zip(lengths, lengths[1:], strict=False)]
            return F.struct(F.array(*counts, lengths[-1]).alias("n"), symbols.cast("long").alias("symbols"))
        return let(F.regexp_replace(left, CLASSES[i], ""), lambda rest: removed(rest, i + 1, lengths, symbols))

    return removed(text, 0, [], F.lit(0))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_hash(lang: Column, word: Column) -> Column:
    return F.xxhash64(lang, word)


@dataclass
class References:
    classes: dict[str, list[float]]
    words: dict[str, list[tuple[int, float]]]  # language: (word's hash, share of all its words)


def references(docs: DataFrame) -> References:
    """Counted over all of ``docs(text, lang)``."""
    lang = F.coalesce("lang", F.lit("")).alias("lang")
    docs = docs.select(lang, F.coalesce("text", F.lit("")).alias("text"))
    per_doc = docs.select("lang", class_counts(F.col("text"))["n"].alias("c"), F.regexp_count("text", F.lit(WORD)).alias("words"))
    sums = per_doc.groupBy("lang").agg(F.sum("words"), *[F.sum(F.col("c")[i]).alias(f"c{i}") for i in range(len(CLASSES) + 1)])
    classes, total = {}, {}
    for lang_name, n, *counts in sums.collect():  # a row a language
        total[lang_name] = n
        classes[lang_name] = [c / max(1, sum(counts)) for c in counts]
    counted = docs.select("lang", F.explode(words_of(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= COMMON)
    words: dict[str, list[tuple[int, float]]] = {}
    for lang_name, h, n in top.select("lang", word_hash(F.col("lang"), F.col("word")), "n").collect():
        words.setdefault(lang_name, []).append((h, n / total[lang_name]))
    return References(classes, words)


def lookup(entries: list[tuple[int, float]]) -> tuple[Column, int]:
    """A constant hash table: buckets of (h, q)."""
    size = max(16, 4 * len(entries))
    buckets: list[list[dict]] = [[] for _ in range(size)]
    for h, q in sorted(entries):
        buckets[h % size].append({"h": h, "q": q})
    return F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<h:bigint,q:double>>>"), size


def half_terms(p: Column, q: Column) -> Column:
    """A category's part of the Jensen-Shannon divergence."""
    mean = (p + q) / 2
    return F.when(p > 0, p * F.log2(p / mean)).otherwise(0.0) / 2 + F.when(q > 0, q * F.log2(q / mean)).otherwise(0.0) / 2


def class_divergence(counts: Column, n_chars: Column, reference: Column) -> Column:
    own = [counts[i] for i in range(len(CLASSES) + 1)]
    terms = [half_terms(c / F.greatest(n_chars, F.lit(1)), F.coalesce(reference[i], F.lit(0.0))) for i, c in enumerate(own)]
    return F.greatest(F.lit(0.0), sum(terms[1:], terms[0]))


def runs(sorted_: Column) -> Column:
    """Of a sorted array, (value, count) of each value."""
    starts = F.filter(F.sequence(F.lit(1), F.size(sorted_)), lambda i: (i == 1) | (F.get(sorted_, i - 1) != F.get(sorted_, i - 2)))
    return let(starts, lambda s: F.transform(s, lambda i, k: F.struct(F.get(sorted_, i - 1).alias("value"), (F.coalesce(F.get(s, k + 1), F.size(sorted_) + 1) - i).alias("n"))))


def word_divergence(hashes: Column, table_: Column, size: int, reference_mass: Column) -> Column:
    """Over a language's common words and, as one more category, all other words."""
    n = F.greatest(F.size(hashes), F.lit(1)).cast("double")
    found = F.flatten(F.transform(hashes, lambda h: F.filter(F.get(table_, F.pmod(h, F.lit(size)).cast("int")), lambda x: x["h"] == h)))

    def terms(found: Column) -> Column:
        rest = half_terms(1 - F.size(found) / n, 1 - reference_mass)

        def add(total: Column, run: Column) -> Column:
            # a word that is absent gives q / 2; one that is present gives its own term instead
            return total + half_terms(run["n"] / n, run["value"]["q"]) - run["value"]["q"] / 2

        common = F.aggregate(F.when(F.size(found) > 0, runs(found)).otherwise(F.array()), reference_mass / 2, add)
        return rest + common

    return F.greatest(F.lit(0.0), let(F.sort_array(found), terms))


def repeat_words(hashes: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that occur twice or more in the text."""

    def covered(positions: Column) -> Column:
        return F.aggregate(F.transform(positions, lambda p, k: F.least(F.coalesce(F.get(positions, k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x)

    def repeated(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def marks(s: Column) -> Column:
            again = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
            return let(F.sort_array(F.transform(again, lambda x: x["i"])), covered)

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(let(placed, marks))

    windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))
    return F.when(F.size(hashes) < WINDOW + 1, 0).otherwise(let(windows, repeated)).cast("long")


def judge(docs: DataFrame, refs: References) -> DataFrame:
    """Counts, distances and verdict of each row of ``docs(doc_id, text, lang)``."""
    table_, size = lookup([x for entries in refs.words.values() for x in entries])
    masses = {k: sum(q for _, q in v) for k, v in refs.words.items()}
    known = {k: {"c": c, "m": masses.get(k, 0.0)} for k, c in refs.classes.items()}
    per_lang = F.from_json(F.lit(json.dumps(known)), "map<string,struct<c:array<double>,m:double>>")
    lang = F.coalesce("lang", F.lit(""))
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", lang.alias("lang"), text.alias("text"))
    own_lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))
    of_words = let(
        F.transform(words_of(F.col("text")), lambda w: word_hash(F.col("lang"), w)),
        lambda h: F.struct(F.size(h).cast("long").alias("n_words"), repeat_words(h).alias("repeat"), word_divergence(h, table_, size, F.coalesce(per_lang[F.col("lang")]["m"], F.lit(0.0))).alias("word_div")),
    )
    rows = docs.select(
        "doc_id", "lang", of_words.alias("w"), class_counts(F.col("text")).alias("c"),
        let(own_lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    counts = F.col("c.n")
    chars = sum((counts[i] for i in range(1, len(CLASSES) + 1)), counts[0])
    rows = rows.select(
        "doc_id", F.col("w.n_words").alias("n_words"), (chars - counts[1]).alias("word_chars"), F.col("c.symbols").alias("n_symbols"), "n_dup_lines", F.col("w.repeat").alias("n_repeat_words"),
        F.sqrt(class_divergence(counts, chars, per_lang[F.col("lang")]["c"])).alias("class_distance"), F.sqrt("w.word_div").alias("word_distance"),
    )
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    noise = COMMON / (8 * 0.6931 * F.greatest(F.col("n_words"), F.lit(1)))
    far = (F.col("n_words") >= MIN_CLASS_WORDS) & (F.col("class_distance") > MAX_CLASS_DISTANCE)
    far |= (F.col("n_words") >= MIN_WORD_WORDS) & (F.col("word_distance") * F.col("word_distance") > MAX_WORD_DIVERGENCE + noise)
    return rows.withColumn("base_failed", base).withColumn("kept", ~base & ~far)


def op9_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, references(docs))
