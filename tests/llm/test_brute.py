"""The queries and the pipeline, whole, against plain Python."""

import gzip
import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from radiolake.llm import linededup, mixing, pieces, quality, queries, rules, sharding, simhash, warc
from tests.llm.test_corpus import WORD, base_spans, counted, five_words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def hostile(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and ids."""
    long = "word " * 20_000
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", None, 0), (3, "a", None, "s", 1), (4, long, "en", "s", len(long)), (5, long, "en", "t", len(long)), (5, "other words", "en", "t", 11), (6, "x" * 30_000, "fr", "t", 30_000)]
    return spark.createDataFrame([*rows, rows[3], rows[0]], "doc_id long, text string, lang string, source string, n_chars long")


def spark_hash(*values):
    """XXH64 chained over (kind, value), as the built-in function does; null leaves the hash as it is."""
    h = 42
    for kind, v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if kind == "s" else struct.pack("<q" if kind == "q" else "<i", v), h)
    return h - (1 << 64) if h >> 63 else h


def text_hash(text):
    return spark_hash(("i", 7), ("s", text), ("i", int(text is None)))


def rows_of(query, spark, *order):
    return sorted(map(tuple, queries.QUERIES[query](spark, SF).select(*order).collect()))


def test_sharding(spark, documents):
    keyed = []
    for i, text, *_ in documents:
        th = text_hash(text)
        h = spark_hash(("q", i), ("q", th))
        keyed.append((h % sharding.BUCKETS, h, i, th, text or ""))
    n = len(keyed)
    a, b = sharding.domain(n)

    def turned(x):
        left, right = x // b, x % b
        for i in range(1, 7):
            if i % 2:
                left = (left + spark_hash(("q", right), ("i", i), ("i", 0)) % a) % a
            else:
                right = (right + spark_hash(("q", left), ("i", i), ("i", 0)) % b) % b
        return left * b + right

    want = []
    for number, (_, _, i, _, text) in enumerate(sorted(keyed)):
        at = turned(number)
        while at >= n:
            at = turned(at)
        data = text.encode()
        want.append((i, len(data) + 8, zlib.crc32(data), "rows", at % 24, at // 24, None))
    got = rows_of("op3_feistel_sharding", spark, "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    assert got == sorted(want)


def drawn_blocks(documents):
    """{doc's place: draws} and targets, a block at a time."""
    sizes, blocks, words = Counter(), [], defaultdict(Counter)
    for i, text, _, source in documents:
        size = len(WORD.findall(text or ""))
        block = spark_hash(("i", 0), ("q", i), ("q", text_hash(text))) % mixing.BLOCKS
        sizes[source] += size
        words[source][block] += size
        blocks.append((source, block, size))
    targets, draws = mixing.targets(dict(sizes)), Counter()
    for source, own in words.items():
        target = targets[source]
        if not sizes[source]:
            continue
        order = sorted((r, spark_hash(("i", 0), ("i", r), ("i", b)), b, w) for r in range(math.floor(target / sizes[source]) + 1) for b, w in own.items() if w)
        taken, drawn, left = 0, [], []
        before = 0
        for at, (_, _, b, w) in enumerate(order):
            if before + w / 2 <= target:
                drawn.append(b)
                taken += w
            else:
                left.append((abs(target - w), at, b, w))
            before += w
        missing = target - taken
        if left:
            _, _, b, w = min((abs(missing - w), at, b, w) for _, at, b, w in left)
            if abs(missing - w) < abs(missing):
                drawn.append(b)
        for b in drawn:
            draws[source, b] += 1
    return sizes, targets, [(size, draws[source, block]) for source, block, size in blocks]


def test_mixing(spark, documents):
    sizes, targets, per_doc = drawn_blocks(documents)
    want = sorted((d[0], size, sizes[d[3]], size * n) for d, (size, n) in zip(documents, per_doc, strict=True))
    assert rows_of("op4_source_mix", spark, "doc_id", "size", "source_size", "taken") == want
    got = dict(rows_of("op4_source_mix", spark, "doc_id", "target"))
    assert all(got[d[0]] == pytest.approx(targets[d[3]]) for d in documents)


def test_mix_shards(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    _, _, per_doc = drawn_blocks(documents)
    rows = mixing.mix(docs, 7).withColumn("part", F.spark_partition_id()).select("doc_id", "shard", "part").collect()
    assert Counter(r["doc_id"] for r in rows) == Counter({d[0]: n for d, (_, n) in zip(documents, per_doc, strict=True) if n})
    assert len({(r["shard"], r["part"]) for r in rows}) == 7 == len({r["part"] for r in rows})
    assert mixing.plan_mix(docs, shard_words=5000).shards == math.ceil(sum(s for s, _ in per_doc) / 5000)


def test_mix_of_many_shards(spark):
    """More shards than a source has blocks: none stays empty (a shard has 16 documents on average), and each has its share of either source."""
    rows = [(i, f"word {i} and more", "ab"[i % 5 == 0]) for i in range(80_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    planned = mixing.plan_mix(docs.filter("source = 'a'"), 4000)
    assert planned.parts >= 32000 / sum(n // planned.parts for _, n in planned.quotas)
    found = Counter(r["shard"] for r in mixing.mix(docs.filter("source = 'a'"), 4000).select("shard").collect())
    assert len(found) == 4000 and max(found.values()) <= 48
    both = Counter((r["shard"], r["source"]) for r in mixing.mix(docs, 600).select("shard", "source").collect())
    assert len({k for k, _ in both}) == 600 and max(both.values()) < 4 * sum(both.values()) / 600


def test_leaves_are_the_tree():
    quotas, shards = np.array([50, 0, 333]), 13
    per_shard = mixing.split_quotas(quotas, shards, 5)
    source = np.repeat(np.arange(3), quotas)
    place = np.concatenate([np.arange(n) for n in quotas])
    expected = np.concatenate([np.repeat(np.arange(shards), per_shard[:, i]) for i in range(3)])
    order = np.random.default_rng(1).permutation(len(place))
    assert (mixing.leaves(quotas, shards, 5, source[order], place[order]) == expected[order]).all()


NAMES = ["taken", "draw", "draws", "size", "target", "source_size", "parts", "block", "words", "fp", "node", "label", "key", "first", "hash", "place", "keys"]


@pytest.mark.parametrize("operator", ["mix", "drop_similar", "drop_near_duplicates", "shard_rows"])
def test_columns_of_clashing_names(spark, hostile, operator):
    """An operator's own names in its input: with underscores they are left out, without they stay."""
    from radiolake.llm import similar

    own = ["__draw", "__draws", "__block", "__node", "__first", "__hash", "__fp", "__kept", "__id", "__size", "__number", "__rank", "__at", "__source", "__target", "__order", "__bucket"]
    wide = hostile.withColumns({n: F.lit(n) for n in [*NAMES, *own]})
    run = {"mix": mixing.mix, "drop_similar": similar.drop_similar, "drop_near_duplicates": simhash.drop_near_duplicates, "shard_rows": lambda d: sharding.shard_rows(d, 3, [F.col("doc_id"), F.col("text")])}[operator]
    out = run(wide)
    assert set(hostile.columns) | set(NAMES) <= set(out.columns) and not any(c.startswith("__") for c in out.columns)
    rows = out.collect()
    assert all(r[n] == n for r in rows for n in NAMES)
    key = lambda r: tuple(map(str, (r[c] for c in hostile.columns)))
    assert sorted(map(key, rows)) == sorted(map(key, run(hostile).collect()))


def test_trees_hold_many_fingerprints(spark):
    """Half the fingerprints of a table lie in shards of at least a hundred, whatever their number, and shards meet all pairs."""
    rng = np.random.default_rng(12)
    for n in (300, 5_000, 40_000):
        fps = spark.createDataFrame([(int(x),) for x in rng.integers(-(2**63), 2**63 - 1, n)], "fp long")
        sizes = [r["count"] for r in fps.select(F.explode(simhash.shard_keys(F.col("fp"), simhash.shard_bits(n))).alias("key")).groupBy("key").count().collect()]
        assert sum(sizes) == 3 * n and np.median(sizes) >= 100 and max(sizes) < 2000
    for bits in (0, 5, 21, 25, 32):
        for _ in range(40):
            a = int(rng.integers(0, 2**63))
            b = a ^ (1 << int(rng.integers(0, 64))) ^ (1 << int(rng.integers(0, 64)))
            rows = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in (a, b)], "fp long") if not _ % 20 else None
            if rows is not None:
                one, two = (set(r[0]) for r in rows.select(simhash.shard_keys(F.col("fp"), bits)).collect())
                assert one & two


def test_risk_and_its_gradient():
    rng = np.random.default_rng(4)
    x = np.hstack([rng.normal(size=(60, 3)), np.ones((60, 1))])
    positive, prior, w = rng.random(60) < 0.3, 0.4, rng.normal(size=4)
    soft = lambda w: np.logaddexp(0, x @ w)
    negative = lambda w: soft(w).mean() - prior * soft(w)[positive].mean()
    risk = lambda w: soft(w).mean() - prior * (x @ w)[positive].mean()
    slope = lambda f: np.array([(f(w + e) - f(w - e)) / 2e-5 for e in np.eye(4) * 1e-5])
    s = quality.risk_parts(x, positive, w)
    value, step = quality.newton_step(s, 60, prior, w, 1e-12)
    assert value == pytest.approx(negative(w))
    hessian = s[15:].reshape(4, 4) / 60 + np.diag([1e-3, 1e-3, 1e-3, 0]) + 1e-6 * np.eye(4)
    penalty = np.array([1e-3, 1e-3, 1e-3, 0]) * w
    full = -np.linalg.solve(hessian, slope(risk) + penalty)
    assert step == pytest.approx(full * min(1, 4 / np.abs(full).max()), abs=1e-4)
    low, up = quality.newton_step(s, 60, 2.5, w, 1e-12)
    prior = 2.5
    assert low == pytest.approx(negative(w)) and low < 0 and up @ slope(negative) > 0
    assert quality.least_ratio(np.bincount([9] * 40 + [1] * 60, minlength=10), np.bincount([9] * 95 + [1] * 5, minlength=10)) == pytest.approx(0.4 / 0.95)


def test_quality_query(spark, documents):
    out = queries.QUERIES["op6_pu_quality"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(d[0] for d in documents)
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)


def test_quality_of_hostile_texts(spark, hostile):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 1), (3, None), (4, 0)], "doc_id long, quality int")
    model = quality.train(hostile, labels)
    scores = hostile.select("text", model.score(F.col("text")).alias("s")).collect()
    assert all(0 <= r["s"] <= 1 for r in scores) and len({r["s"] for r in scores if not r["text"]}) == 1
    assert quality.train(hostile, labels.limit(0)).prior == 0.5


def test_pii_query(spark, documents):
    names, want = ("email", "ip", "card", "phone"), []
    for i, text, *_ in documents:
        spans = base_spans(text or "")
        line = ",".join(f"{names[k]}:{s}:{e}" for k, s, e in spans)
        want.append((i, *(sum(k == j for k, *_ in spans) for j in range(4)), hashlib.sha256(line.encode()).hexdigest()))
    assert rows_of("op5_bootstrapped_pii", spark, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want)


def class_shares(text):
    """Letters a-z, white space, A-Z, digits, punctuation, symbols, others."""
    groups = ["abcdefghijklmnopqrstuvwxyz", "\x20\x09\x0a\x0b\x0c\x0d", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:?()'\"-!"[:-1], "#*$%&|<>!@^~=+_{}[]\\/`"]
    return [sum(c in g for c in text) for g in groups] + [sum(not any(c in g for g in groups) for c in text)]


def divergence(p, q):
    m = (p + q) / 2
    part = lambda a: np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0).sum() / 2
    return max(0.0, part(p) + part(q))


def test_rules(spark, documents):
    classes, words = defaultdict(lambda: np.zeros(7)), defaultdict(Counter)
    for _, text, lang, _ in documents:
        classes[lang or ""] += class_shares(text or "")
        words[lang or ""].update(WORD.findall(text or ""))
    out = {r["doc_id"]: r for r in queries.QUERIES["op9_divergence_rules"](spark, SF).collect()}
    assert len(out) == len(documents)
    for i, text, lang, _ in documents:
        lang, own = lang or "", WORD.findall(text or "")
        n, rest = len(own), counted(text or "")
        share = np.array(class_shares(text or "")) / max(1, len(text or ""))
        by_class = math.sqrt(divergence(share, classes[lang] / classes[lang].sum()))
        top = sorted(words[lang], key=lambda w: (-words[lang][w], w.encode()))[: rules.COMMON]
        q = np.array([words[lang][w] for w in top]) / sum(words[lang].values())
        p = np.array([own.count(w) for w in top]) / max(1, n)
        by_word = divergence(np.append(p, 1 - p.sum()), np.append(q, 1 - q.sum()))
        failed = n < 10 or 100 * rest[-1] > 20 * n
        far = n >= rules.MIN_CLASS_WORDS and by_class > rules.MAX_CLASS_DISTANCE or n >= rules.MIN_WORD_WORDS and by_word > rules.MAX_WORD_DIVERGENCE + rules.COMMON / (8 * 0.6931 * n)
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == rest
        assert r["class_distance"] == pytest.approx(by_class, abs=1e-6) and r["word_distance"] ** 2 == pytest.approx(by_word, abs=1e-6)
        assert (r["base_failed"], r["kept"]) == (failed, not failed and not far)


def without_repeats(rows):
    """Texts without runs of repeated chunks; rows (doc_id, text) in any order."""
    chunks = {}
    for i, text in rows:
        lines = re.split(linededup.LINE_ENDS, text)
        hashes = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
        out, start = [], 0
        for at in range(1, len(lines) + 1):
            roll = sum((hashes[at - 1 - k] if at - 1 - k >= 0 else 0) * pow(linededup.BASE, k, linededup.MODULUS) for k in range(linededup.WINDOW)) % linededup.MODULUS
            if at == len(lines) or roll % linededup.MEAN_LINES == 0:
                out.append((at - start, "".join(lines[start:at])))
                start = at
        chunks[i] = out
    seen, texts = set(), {}
    for i in sorted(chunks):
        flags = []
        for _, body in chunks[i]:
            flags.append(body in seen)
            seen.add(body)
        out, k = [], 0
        while k < len(flags):
            end = k
            while end < len(flags) and flags[end] == flags[k]:
                end += 1
            run = chunks[i][k:end]
            if not (flags[k] and sum(len(b) for _, b in run) >= linededup.MIN_CHARS and sum(n for n, _ in run) > 1 and max(len(b) for _, b in run) >= linededup.ANCHOR_CHARS):
                out += [b for _, b in run]
            k = end
        texts[i] = "".join(out)
    return texts


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages, outputs = [f for _, f in corpus_pipeline.STAGES], []
    for stage in stages:
        docs = simhash.stage_table(stage(spark, docs, SF), "test-stage")
        outputs.append([r.asDict() for r in docs.collect()])
    one, two, three, four, five = outputs
    model = quality.fit_on_corpus(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    scored = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", model.score(F.col("text")).alias("s")).collect()
    assert sorted(r["doc_id"] for r in one) == sorted(r["doc_id"] for r in scored if r["s"] >= 0.7)
    assert {r["doc_id"]: r["text"] for r in two} == without_repeats([(r["doc_id"], r["text"]) for r in one])
    sets, label = {r["doc_id"]: five_words(r["text"]) for r in two}, {r["doc_id"]: r["doc_id"] for r in two}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and label[a] != label[b] and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    assert sorted(r["doc_id"] for r in three) == sorted(set(label.values()))
    _, _, per_doc = drawn_blocks([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in three])
    assert Counter(r["doc_id"] for r in four) == Counter({r["doc_id"]: n for r, (_, n) in zip(three, per_doc, strict=True) if n})
    assert sorted(r["doc_id"] for r in five) == sorted(r["doc_id"] for r in four) and all(r["decoded"] for r in five)
    v = pieces.Vocabulary()
    assert all(v.decode(r["ids"]) == r["text"] for r in five)
    assert sorted(map(str, corpus_pipeline.run(spark, SF).select("doc_id").collect())) == sorted(str((r["doc_id"],)).replace("(", "Row(doc_id=").replace(",)", ")") for r in five)


@pytest.mark.parametrize("k", range(5))
def test_stages_on_hostile_and_empty_tables(spark, hostile, k):
    stage = corpus_pipeline.STAGES[k][1]
    for docs in (hostile, hostile.withColumn("__x", F.lit(1)).withColumn("size", F.lit("s"))):
        out = stage(spark, docs, SF)
        assert out.count() >= 0 and set(corpus_pipeline.COLUMNS) <= set(out.columns)
    assert stage(spark, hostile.limit(0), SF).count() == 0


def test_every_query_has_rows(spark, documents):
    for name in ("op2_line_chunks", "op8_nbest_pieces", "op10_simhash_bktree"):
        assert queries.QUERIES[name](spark, SF).count() == len(documents)


def test_segments_of_long_runs():
    v = pieces.Vocabulary()
    for text in ("x" * 50_000, "ab" * 5_000 + "é" * 300, "".join(chr(97 + i * i % 26) for i in range(3_000))):
        found = pieces.Segmenter(v).encode([text], 4)[0]
        scores = [s for s, _ in found]
        assert scores == sorted(scores, reverse=True) and all(v.decode(ids.tolist()) == text for _, ids in found)
        assert len({ids.tobytes() for _, ids in found}) == len(found) > 1


def test_cut_archives_are_refused(tmp_path):
    """Cut before, at and after each record's end, and in the trailer, flushed after every record."""
    records = [warc.record_bytes(i, "u", f"page {i}".encode(), None) for i in range(4)]
    gz, data, ends = zlib.compressobj(6, zlib.DEFLATED, 31), b"", []
    for r in records:
        data += gz.compress(r) + gz.flush(zlib.Z_SYNC_FLUSH)
        ends.append(len(data))
    data += gz.flush()
    assert gzip.decompress(data) == b"".join(records)

    class Source:
        def __init__(self, data):
            self.data = data

        def read(self, n):
            out, self.data = self.data[:n], self.data[n:]
            return out

    def read(data):
        stream, n = warc.Inflated(Source(data)), 0
        while raw := stream.until(b"\r\n\r\n"):
            list(stream.pieces(int(warc.headers(raw.lstrip(b"\r\n")[:-4])["Content-Length"]) + 4))
            n += 1
        return n

    assert read(data) == 4 and read(b"") == 0 and read(data + data) == 8
    for cut in {*ends, *(e - 1 for e in ends), *(e + 1 for e in ends), len(data) - 1, len(data) - 5, len(data) + 3}:
        with pytest.raises((EOFError, ValueError)):
            read((data + data)[:cut])


def test_pages_with_odd_ids(spark):
    rows = [(None, None, "a", 1), (None, "u", "a", 2), (3, "u", "a", 3), (3, "u", "a", 4), (3, "v", "b", 5), (7, "u", None, 6), (8, "u", "", 7), (2**40, "x y", "é" * 50_000, 8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int")
    out = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archive_pages(pages).collect()), key=str)
    assert out == sorted([(None, 1, "revisit", 3), (None, 1, "revisit", 3), (3, 1, "response", None), (3, 1, "response", None), (3, 1, "response", None), (7, 0, "response", None), (8, 0, "revisit", 7), (2**40, 100_000, "response", None)], key=str)
