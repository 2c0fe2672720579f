"""Importance resampling, whitening and language-model scores against brute force in plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from radiolake.llm import importance, queries, recurrent, whitening

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def hostile(spark):
    """Nulls, empty and long texts, ties, repeated rows and ids, and columns with clashing names."""
    rows = [(None, None), (1, None), (2, ""), (3, "a"), (4, "Word é " * 9_000), (5, "Word é " * 9_000), (5, "other words here"), (6, "x" * 30_000 + " " + "y" * 70), (7, "　日本 \x00 a\x1fb"), (3, "a"), (None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("s"), "rank": F.lit(1), "__f": F.lit(2), "row": F.lit(3), "n_words": F.lit(4), "token": F.lit(5), "side": F.lit(6)})


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def grams(text, longest):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute_scores(docs, target, longest, buckets, seed=2024):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for x in texts for g in grams(x, longest)) for texts in ([x for _, x in docs], target))
    sn, tn = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sn + buckets) / ((s[b] + 1) * (tn + buckets))))
    out = []
    for i, text in docs:
        g = grams(text, longest)
        weight = sum(gain(bucket(x)) for x in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(words(text)), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    return out


def test_crcs_of_runs_are_composed():
    rng = np.random.default_rng(3)
    texts = [" ".join("".join(rng.choice(list("abéz日0"), rng.integers(1, 70 if k % 5 else 3))) for _ in range(rng.integers(0, 30))).encode() for k in range(40)] + [b"", b"a"]
    bounds = np.append(0, np.cumsum([len(t) for t in texts]))
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts, stops, of = importance.word_spans(data, bounds)
    found = {(n, i) for n, (crc, own) in enumerate(importance.ngram_crcs(importance.word_crcs(data, starts, stops), stops - starts, of, 5), 1) for i in zip(own.tolist(), crc.tolist(), strict=True)}
    assert found == {(n, (i, zlib.crc32(b" ".join(w[j : j + n])))) for i, t in enumerate(texts) for w in [t.split()] for n in range(1, 6) for j in range(len(w) - n + 1)}
    assert importance.shifted(np.array([zlib.crc32(b"ab")], np.uint32), np.array([1_000_003]))[0] == zlib.crc32(b"ab" + bytes(1_000_003)) ^ zlib.crc32(bytes(1_000_003))


@pytest.mark.parametrize("longest", [1, 3])
def test_scores(spark, documents, longest):
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    out = importance.scored(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"), longest, 500)
    assert sorted(map(tuple, out.select("doc_id", "n_words", "n_features", "weight", "score").collect())) == sorted(brute_scores(documents, target, longest, 500))


def test_ranks(spark, documents):
    rows = brute_scores(documents, [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()], 1, 10_000)
    most = sorted((-s, i) for i, n, _, _, s in rows if n >= 20)
    drawn = {i: k for k, (_, i) in enumerate(most[: len(most) * 10 // 100], 1)}
    out = queries.QUERIES["op11_importance_resampling"](spark, SF).collect()
    assert {(r["doc_id"], r["score"], r["rank"]) for r in out} == {(i, s, drawn.get(i)) for i, _, _, _, s in rows}
    ties = spark.createDataFrame([(i, 30, 1, 5, i % 3) for i in range(90)], "doc_id long, n_words long, n_features long, weight long, score long")
    out = {r["doc_id"]: r["rank"] for r in importance.ranked(ties, (1, 2)).collect()}
    assert {i: k for i, k in out.items() if k} == {i: k for k, i in enumerate(sorted(range(90), key=lambda i: (-(i % 3), i))[:45], 1)}


def test_resampling_hostile_tables(spark, hostile):
    target = hostile.select("text")
    out = importance.scored(hostile, target, 2, 100)
    assert set(out.columns) == {"doc_id", "text", "row", "token", "side", "n_words", "n_features", "weight", "score"}
    got = sorted(((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"]) for r in out.collect()), key=str)
    rows = [(r["doc_id"], r["text"]) for r in hostile.collect()]
    assert got == sorted(brute_scores(rows, [x for _, x in rows], 2, 100), key=str)
    assert importance.resample(hostile, target, (1, 1), 1).count() == sum(bool(words(x)) for _, x in rows)
    assert importance.resample(hostile.limit(0), target).count() == 0 and importance.resample(hostile, target.limit(0), (1, 1), 0).count() == len(rows)


def test_eigenvectors():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 8, 33, 64):
        b = rng.normal(size=(n, n))
        low = rng.normal(size=(n, max(1, n // 3)))
        for a in (b @ b.T, low @ low.T, np.eye(n), np.ones((n, n)) + np.diag(np.round(rng.random(n), 1)), np.zeros((n, n)), np.diag(np.arange(n) - 2.0)):
            w, v = whitening.eigen(a)
            size = max(np.abs(a).max(), 1e-300) * n
            assert np.abs(w - np.linalg.eigvalsh(a)[::-1]).max() < 1e-13 * size
            assert np.abs(v.T @ v - np.eye(n)).max() < 1e-13 and np.abs(a @ v - v * w).max() < 1e-13 * size


def exact_covariance(x):
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    return [[Fraction(sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x), n**3) for j in range(len(sums))] for i in range(len(sums))]


def test_covariance_is_compensated(spark):
    """A spread of one in a mean of 2**40: plain sums of squares would have no digit right."""
    rng = np.random.default_rng(6)
    x = (rng.integers(0, 3, (3000, 3)) + [2**40, -(2**40), 5]).tolist()
    model = whitening.fit(spark.createDataFrame([(r,) for r in x], "x array<long>").repartition(5))
    exact = np.array([[float(c) for c in row] for row in exact_covariance(x)])
    assert np.abs((model.vectors * model.values) @ model.vectors.T - exact).max() < 1e-14
    block = np.array(x[:1000], float)
    mean = [Fraction(sum(r[i] for r in x), len(x)) for i in range(3)]
    pair = np.array([[float(m) for m in mean], [float(m - Fraction(float(m))) for m in mean]])
    total = np.zeros((2, 3, 3))
    whitening.add_outer(total, *whitening.centred(block, pair))
    true = [[sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in x[:1000]) for j in range(3)] for i in range(3)]
    assert max(abs((Fraction(total[0][i][j]) + Fraction(total[1][i][j]) - true[i][j]) / true[i][i]) for i in range(3) for j in range(3)) < Fraction(1, 2**64)  # a mean of 2**40 in two doubles


def test_whitening_query(spark):
    rows = [(r["vec_id"], [math.floor(64 * c) + 1_000_000 for c in r["embedding"]]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    n, sums = len(rows), [sum(c) for c in zip(*(x for _, x in rows), strict=True)]
    v = np.array([[float(c) for c in row] for row in exact_covariance([x for _, x in rows])])
    w, u = np.linalg.eigh(v)
    w, u = w[::-1][:32], u[:, ::-1][:, :32]
    white = {i: np.array([float(c - Fraction(s, n)) for c, s in zip(x, sums, strict=True)]) @ u / np.sqrt(w) for i, x in rows}
    deviations = {i: sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)) for i, x in rows}
    out = queries.QUERIES["op12_embedding_whitening"](spark, SF).collect()
    assert sorted((r["vec_id"], r["component"]) for r in out) == sorted((i, k) for i, _ in rows for k in range(1, 33))
    signs = {}
    for r in out:
        k, expected = r["component"], white[r["vec_id"]][r["component"] - 1]
        if abs(expected) > 0.1:
            assert signs.setdefault(k, np.sign(r["whitened"] * expected)) == np.sign(r["whitened"] * expected)
        assert abs(abs(r["whitened"]) - abs(expected)) < 1e-8 and (r["n"], r["deviation"]) == (n, deviations[r["vec_id"]])
        assert abs(r["explained"] - w[k - 1] / np.trace(v)) < 1e-12 and r["identity_error"] < 1e-10


def test_whitening_hostile_vectors(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    usable = [(1, [0.5, 1.0, 0.25]), (2, [0.25, -1.0, 0.125]), (None, [1e30, 2.0, 0.0]), (2, [0.25, -1.0, 0.125]), (9, [-1e30, 0.0, 0.0])]
    rows = [*usable, (3, None), (4, []), (5, [1.0, None, 2.0]), (6, [nan, 1.0, 2.0]), (7, [1.0, -inf, 2.0]), (8, [1.0, 2.0])]
    wide = lambda r: spark.createDataFrame(r, "vec_id long, embedding array<float>").withColumns({"x": F.lit(1), "__w": F.lit(1), "component": F.lit(2)})

    def run(r, name):
        wide(r).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        return queries.QUERIES["op12_embedding_whitening"](spark, f"{tmp_path}/{name}").collect()

    out = run(rows, "a")
    assert Counter(r["vec_id"] for r in out) == Counter({i: 3 * n for i, n in Counter(i for i, _ in usable).items()}) and {r["n"] for r in out} == {5}
    assert all(r["deviation"] is None for r in out if r["vec_id"] in (None, 9))
    one = run([(1, [0.5, 1.0])], "b")
    assert len(one) == 2 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in one)
    assert run(rows[5:-1], "c") == [] and run([], "d") == []


def test_vectors_on_a_line_have_one_component(spark):
    model = whitening.fit(rows := spark.createDataFrame([([i, 2 * i, -i],) for i in range(50)], "x array<long>"))
    white = model.transform(rows)
    assert (model.values > 0).tolist() == [True, False, False] and whitening.identity_error(white, model) < 1e-12
    assert all(r["whitened"][0] is not None and r["whitened"][1:] == [None, None] for r in white.collect())


def brute_tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), ""]


def brute_base(docs):
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = Counter(t for i, text in docs if not held(i) for t in brute_tokens(text))
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(t), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t)) for i, text in docs for t in [brute_tokens(text)]]


def same_base(out, docs):
    key = lambda r: (str(r[0]), r[2], r[3])
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in out), key=key)
    expected = sorted(brute_base(docs), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in expected] and all(abs(a[5] - b[5]) < 1e-6 * (1 - b[5]) for a, b in zip(got, expected, strict=True))


def test_language_model_query(spark, documents, monkeypatch):
    out = queries.QUERIES["op13_recurrent_scores"](spark, SF).collect()
    same_base(out, documents)
    monkeypatch.setattr(recurrent, "FREQUENT", 300)  # most tokens by the join
    rare = recurrent.score(spark.read.parquet(f"{SF}/documents.parquet")).withColumn("held_out", recurrent.held_out(F.col("doc_id"))).collect()
    same_base(rare, documents)


def test_held_out_text_is_predicted(spark, documents):
    """Better than single tokens' shares, on texts it never saw, by a tenth of a digit a token."""
    rows = queries.QUERIES["op13_recurrent_scores"](spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert (rows["s"] - rows["b"]) / rows["n"] > 0.1


@pytest.fixture(scope="module")
def small():
    tokens = [b"w%d" % i for i in range(900)]
    counts = (9_000 / np.arange(1, 901)).astype(np.int64)
    tails = np.zeros((2, recurrent.TAILS))
    for t, c in zip(tokens[recurrent.HEAD :], counts[recurrent.HEAD :].tolist(), strict=True):
        tails[:, recurrent.tail_class(t) - recurrent.HEAD // recurrent.WIDTH] += c, 1
    return recurrent.Vocabulary(tokens, counts, tails, int(counts.sum()), 900)


def test_token_probabilities_sum_to_one(small):
    net = recurrent.Network.first(small, 4)
    h = np.random.default_rng(1).normal(size=(1, recurrent.HIDDEN)).astype(np.float32)
    numbers = np.arange(900)
    cls, place = small.units(numbers)
    known = np.exp(net.logs(np.repeat(h, 900, 0), cls, place) + small.tail_log(numbers)).sum()
    tails = np.arange(recurrent.TAILS) + recurrent.HEAD // recurrent.WIDTH
    unseen = (np.exp(net.logs(np.repeat(h, len(tails), 0), tails, np.full(len(tails), -1))) / (small.tails.sum(0) + 1)).sum()
    assert abs(known + unseen - 1) < 1e-5


def test_gradients(small):
    rng = np.random.default_rng(2)
    net = recurrent.Network.first(small, 5)
    numbers, lengths = recurrent.numbers_of([b"w%d" % i for i in rng.zipf(1.3, 90) % 1000], recurrent.ids_of(small.tokens)), np.array([30, 1, 25, 34])
    x, cls, place, position = next(recurrent.windows(net, small, numbers, lengths, 3))
    h = rng.normal(size=(x.shape[1], recurrent.HIDDEN)).astype(np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    g = net.gradients(x, h, cls, place, position >= 0)[0]
    for k, v in net.p.items():
        for at in np.argsort(-np.abs(g[k]).ravel())[:4]:
            losses = []
            for d in (1e-3, -1e-3):
                v.flat[at] += d
                losses.append(net.gradients(x, h, cls, place, position >= 0)[2])
                v.flat[at] -= d
            assert abs((losses[0] - losses[1]) / 2e-3 - g[k].flat[at]) < 0.02 * abs(g[k].flat[at]) + 0.02, k


def test_state_is_carried_and_neighbours_do_not_matter(small):
    """A text's score by windows, beside others, equals a plain loop over its tokens."""
    rng = np.random.default_rng(3)
    net = recurrent.Network.first(small, 6)
    lengths = np.array([70, 1, 33, 5, 16, 200])
    numbers = recurrent.numbers_of([b"w%d" % i for i in rng.integers(0, 1000, lengths.sum())], recurrent.ids_of(small.tokens))
    for lanes in (1, 2, 6):
        logs, h = np.zeros(len(numbers)), np.zeros((lanes, recurrent.HIDDEN), np.float32)
        for x, cls, place, position in recurrent.windows(net, small, numbers, lengths, lanes):
            states = net.states(x, h[: x.shape[1]])
            h, on = states[-1], position >= 0
            logs[position[on]] += net.logs(states[on], cls[on], place[on])
        at = 0
        for n in lengths:
            state, before = np.zeros(recurrent.HIDDEN), net.BEGIN
            for i in range(at, at + n):
                a, u = net.p["x"][:, before], net.p["u"]
                r, z = (1 / (1 + np.exp(-(a[k] + state @ u[k]))) for k in (0, 1))
                state = state + z * (np.tanh(a[2] + (r * state) @ u[2]) - state)
                (c,), (p,) = (y for y in small.units(numbers[i : i + 1]))
                said = state @ net.p["c"] + net.p["cb"]
                log = said[c] - np.log(np.exp(said).sum())
                if p >= 0:
                    said = state @ net.p["w"][c] + net.p["wb"][c]
                    log += said[p] - np.log(np.exp(said).sum())
                assert abs(log - logs[i]) < 1e-3
                before = int(net.inputs(np.array([c]), np.array([p]))[0])
            at += n


def test_language_model_hostile_tables(spark, hostile):
    out = recurrent.score(hostile).withColumn("held_out", recurrent.held_out(F.col("doc_id"))).collect()
    same_base(out, [(r["doc_id"], r["text"]) for r in hostile.collect()])
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in out)
    assert recurrent.score(hostile.limit(0)).count() == 0
    untrained = recurrent.score(hostile, F.lit(False)).collect()
    assert len(untrained) == len(out) and {r["train_tokens"] for r in untrained} == {0} and all(r["base_score"] == 0 and math.isfinite(r["score"]) for r in untrained)
