r"""Language-model scoring with a gated recurrent network, learnt from the corpus.

Tokens are a text's words, with A-Z lower-cased, and one end. The network has an output softmax in two
factors: first the class of the next token, then the token within its class. The most frequent tokens
have classes of neighbours in rank, each with a softmax of its own; every other token, seen or not, belongs
to the class of its last two bytes, within which its share is by counts: (c + 1) / (N + V + 1) over the
class's own counts, the one more being for all that was never seen. So a text's probability covers any token.

Training is by gradient steps over windows of a few tokens (back-propagation ends at a window's start, the state goes
on), in numpy, many texts side by side. All training texts take part, in rounds of growing size: in a round, every
task starts from the same parameters and goes through its own texts; the parameters are then averaged by tokens.
Scoring carries the state across all windows of a text, from its first token to its end, however long it is.

Scale: counts are aggregated in tasks before they are shuffled. Tokens that make up at least a ``1 / FREQUENT``
part of all, at most ``FREQUENT`` of them, are broadcast (tokens beyond 64 bytes are replaced by a digest, so this
table is bounded in bytes too); all others are looked up by a join in which, by that bound, no key is hot.
Parameters are of fixed size; in a round one set of them a task is summed by a second layer of tasks.

Defined cases: a null or empty text is its end alone; a null id counts as an empty one, so as training text; without any
training text all counts are zero and the network stays as it begins; repeated rows count, and are scored, each; an empty table gives
an empty one. Of the input only ``doc_id`` and ``text`` are read, so other columns clash with nothing.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.llm.shared import broadcast_if_small, stage_table, table

FREQUENT = 1 << 18
HEAD, WIDTH, TAILS = 512, 32, 32
CLASSES = HEAD // WIDTH + TAILS
HIDDEN = 16
WINDOW = 16
#: Parts of the training texts that the rounds take, in 16ths.
ROUNDS = (1, 2, 13)
CHUNK_BYTES, CHUNK_TOKENS = 2 << 20, 4 << 20
END = b""
COUNTED = pa.schema([("token", pa.binary()), ("c", pa.int64())])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def tokens_of(text: bytes) -> list[bytes]:
    """Words, those beyond 64 bytes by their digest behind a blank, and the end."""
    words = text.lower().split()
    if len(text) > 64 and max(map(len, words), default=0) > 64:
        words = [w if len(w) <= 64 else b" " + hashlib.sha256(w).digest() + w[-2:] for w in words]
    words.append(END)
    return words


def tail_class(token: bytes) -> int:
    return HEAD // WIDTH + zlib.crc32(token[-2:]) % TAILS


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, c) of all texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], schema=COUNTED)
            counts.clear()
            return done

        for b in batches:
            for text in b.column("text"):
                counts.update(tokens_of(text.as_py()))
                if len(counts) > 300_000:
                    yield out()
        yield out()

    return texts.select("text").mapInArrow(counted, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Counts of the frequent tokens, in falling order, the tail class of each, and every tail class's (N, V)."""

    tokens: list[bytes]
    counts: np.ndarray
    tails: np.ndarray
    n: int
    v: int
    tail: np.ndarray | None = None

    def __post_init__(self) -> None:
        if self.tail is None:
            self.tail = np.array([tail_class(t) for t in self.tokens] or [0], np.int16)

    def by_number(self) -> Vocabulary:
        """All that is needed where tokens are numbers already."""
        return replace(self, tokens=[])

    def units(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the network reads and predicts: (class, place in class) of each; the place is -1 in tail classes."""
        known = np.maximum(numbers, 0)
        cls = np.where(numbers < 0, -1 - numbers, np.where(known < HEAD, known // WIDTH, self.tail[known]))
        return cls.astype(np.int16), np.where((numbers >= 0) & (numbers < HEAD), known % WIDTH, -1).astype(np.int16)

    def tail_log(self, numbers: np.ndarray) -> np.ndarray:
        """Natural log of a frequent token's share of its tail class; 0 for others."""
        at = np.flatnonzero(numbers >= HEAD)
        out, of = np.zeros(len(numbers)), self.tail[numbers[at]] - HEAD // WIDTH
        out[at] = np.log((self.counts[numbers[at]] + 1.0) / (self.tails[0, of] + self.tails[1, of] + 1.0))
        return out


_ids: dict[str, object] = {}


def ids_of(tokens: list[bytes]) -> dict[bytes, int]:
    """Tokens' places in their list; kept for the next task of a worker that has the same list."""
    if _ids.get("of") is not tokens:
        _ids.update(of=tokens, ids={t: i for i, t in enumerate(tokens)})
    return _ids["ids"]


def numbers_of(tokens: list[bytes], ids: dict[bytes, int]) -> np.ndarray:
    """Ids of tokens; of those that aren't frequent ``-1 - class``."""
    out = np.fromiter(map(ids.get, tokens, repeat(-1)), np.int32, len(tokens))
    rare = np.flatnonzero(out < 0)
    out[rare] = [-1 - tail_class(tokens[i]) for i in rare.tolist()]
    return out


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From the staged counts: their sums, the frequent tokens, and sums of every tail class over all others."""
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = total.n or 0, total.v
    often = counts.filter(F.col("c") * FREQUENT >= n).orderBy(F.desc("c"), "token").toArrow() if v else pa.table({"token": pa.array([], pa.binary()), "c": pa.array([], pa.int64())})  # at most FREQUENT rows
    tokens, c = often["token"].to_pylist(), often["c"].to_numpy().astype(np.int64)
    rest = counts.filter(F.col("c") * FREQUENT < n) if v else counts
    tail = HEAD // WIDTH + F.crc32(F.when(F.length("token") > 2, F.substring("token", -2, 2)).otherwise(F.col("token"))) % TAILS
    tails = np.zeros((2, TAILS))
    for r in rest.groupBy(tail.alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():  # one row a class
        tails[:, r.k - HEAD // WIDTH] += r.n, r.v
    for t, x in zip(tokens[HEAD:], c[HEAD:].tolist(), strict=True):
        tails[:, tail_class(t) - HEAD // WIDTH] += x, 1
    return Vocabulary(tokens, c, tails, n, v)


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def tanh(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= 2
    sigmoid(x)
    x *= 2
    x -= 1
    return x


class Network:
    """Parameters by name. ``x`` holds what each input adds to the reset gate, the update gate and the new state: tokens of the head, tail classes, a beginning."""

    SHAPES = {"x": (3, HEAD + TAILS + 1, HIDDEN), "u": (3, HIDDEN, HIDDEN), "c": (HIDDEN, CLASSES), "cb": (CLASSES,), "w": (HEAD // WIDTH, HIDDEN, WIDTH), "wb": (HEAD // WIDTH, WIDTH)}
    BEGIN = HEAD + TAILS

    def __init__(self, parameters: dict[str, np.ndarray]):
        self.p = parameters

    @classmethod
    def first(cls, vocabulary: Vocabulary, seed: int) -> Network:
        """Small random weights; biases from the counts, so that it begins at the shares of single tokens."""
        rng = np.random.default_rng(seed)
        p = {k: (0.1 * rng.standard_normal(s)).astype(np.float32) for k, s in cls.SHAPES.items()}
        p["u"] *= 3
        head = np.zeros(HEAD)
        head[: min(HEAD, len(vocabulary.counts))] = vocabulary.counts[:HEAD]
        head = head.reshape(-1, WIDTH)
        unused = np.arange(HEAD).reshape(-1, WIDTH) >= max(1, len(vocabulary.counts))
        classes = np.append(head.sum(1) + 1, vocabulary.tails.sum(0) + 1)
        p["cb"] = np.log(classes / classes.sum()).astype(np.float32)
        p["wb"] = np.where(unused & ~unused.all(1, keepdims=True), -30, np.log((head + 1) / (head + 1).sum(1, keepdims=True))).astype(np.float32)
        return cls(p)

    def inputs(self, cls: np.ndarray, place: np.ndarray) -> np.ndarray:
        return np.where(place >= 0, cls * WIDTH + place, HEAD + cls - HEAD // WIDTH).astype(np.int16)

    def states(self, x: np.ndarray, h: np.ndarray, kept: np.ndarray | None = None) -> np.ndarray:
        """States (time, lane, hidden) behind each input; ``kept`` gets, of each, the state before, both gates, what was reset, and the new part."""
        (xr, xz, xn), (ur, uz, un) = self.p["x"], self.p["u"]
        out = np.empty((*x.shape, HIDDEN), np.float32)
        begins = x == self.BEGIN
        for t in range(len(x)):
            if begins[t].any():
                h = h * ~begins[t][:, None]  # a text begins with a state of zeros
            r, z, n = (np.take(w, x[t], axis=0) for w in (xr, xz, xn))
            r += h @ ur
            z += h @ uz
            rh = sigmoid(r) * h
            n += rh @ un
            tanh(n)
            sigmoid(z)
            if kept is not None:
                kept[0, t], kept[1, t], kept[2, t], kept[3, t], kept[4, t] = h, r, z, rh, n
            n -= h
            n *= z
            h = np.add(h, n, out=out[t])
        return out

    def by_class(self, cls: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        head = np.flatnonzero(place >= 0)
        own = cls[head].astype(np.int16)
        head = head[np.argsort(own, kind="stable")]
        ends = np.append(0, np.cumsum(np.bincount(own, minlength=HEAD // WIDTH)))
        for k in range(HEAD // WIDTH):
            if ends[k] < ends[k + 1]:
                yield k, head[ends[k] : ends[k + 1]]

    def exponents(self, h: np.ndarray, w: np.ndarray, b: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """exp(h w + b), its sums, and the logs of the wanted entries' shares."""
        z = h @ w
        z += b
        np.minimum(z, 80, out=z)  # where exp is still a number
        said = z[np.arange(len(z)), wanted]
        np.exp(z, out=z)
        total = z @ np.ones(z.shape[1], np.float32)
        return z, total, said - np.log(total)

    def logs(self, h: np.ndarray, cls: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Natural logs of each token's class and place, given the state before it."""
        out = self.exponents(h, self.p["c"], self.p["cb"], cls)[2].astype(np.float64)
        for k, at in self.by_class(cls, place):
            out[at] += self.exponents(np.take(h, at, axis=0), self.p["w"][k], self.p["wb"][k], place[at])[2]
        return out

    def slopes(self, h: np.ndarray, w: np.ndarray, b: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Gradients of the loss by w, b and h, and the loss, of wanted entries of a softmax."""
        d, total, said = self.exponents(h, w, b, wanted)
        d *= (1 / total)[:, None]
        d[np.arange(len(d)), wanted] -= 1
        return (d.T @ h).T, np.ones(len(d), np.float32) @ d, d @ w.T, -float(said.sum())

    def gradients(self, x: np.ndarray, h: np.ndarray, cls: np.ndarray, place: np.ndarray, on: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Gradients of one window's loss, its last states, and the loss; ``on`` marks the tokens that count. Both are sums."""
        p, (steps, lanes) = self.p, x.shape
        kept = np.empty((5, steps, lanes, HIDDEN), np.float32)
        states = self.states(x, h, kept)
        at = np.flatnonzero(on.ravel())
        flat, c, w = states.reshape(-1, HIDDEN)[at], cls.ravel()[at], place.ravel()[at]
        g = {k: np.zeros_like(p[k]) for k in ("u", "w", "wb")}
        g["c"], g["cb"], back, loss = self.slopes(flat, p["c"], p["cb"], c)
        for k, own in self.by_class(c, w):
            g["w"][k], g["wb"][k], more, said = self.slopes(np.take(flat, own, axis=0), p["w"][k], p["wb"][k], w[own])
            back[own] += more
            loss += said
        dh_all = np.zeros((steps * lanes, HIDDEN), np.float32)
        dh_all[at] = back
        dh_all = dh_all.reshape(steps, lanes, HIDDEN)
        before, r, z, rh, n = kept
        to_r, to_z, to_n, stays = before * r * (1 - r), (n - before) * z * (1 - z), z * (1 - n * n), 1 - z
        da = np.empty((3, steps, lanes, HIDDEN), np.float32)
        (urt, uzt, unt), begins = (np.ascontiguousarray(u.T) for u in p["u"]), x == self.BEGIN
        dh = np.zeros((lanes, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            dh += dh_all[t]
            np.multiply(dh, to_z[t], out=da[1, t])
            dn = np.multiply(dh, to_n[t], out=da[2, t])
            drh = dn @ unt
            np.multiply(drh, to_r[t], out=da[0, t])
            dh *= stays[t]
            drh *= r[t]
            dh += drh
            dh += da[0, t] @ urt
            dh += da[1, t] @ uzt
            if begins[t].any():
                dh[begins[t]] = 0
        da = da.reshape(3, -1, HIDDEN)
        for i, source in enumerate((before, before, rh)):
            g["u"][i] = source.reshape(-1, HIDDEN).T @ da[i]
        index = (x.reshape(-1, 1) * HIDDEN + np.arange(HIDDEN)).ravel()
        size = (HEAD + TAILS + 1) * HIDDEN
        g["x"] = np.array([np.bincount(index, weights=part.ravel(), minlength=size) for part in da], np.float32).reshape(p["x"].shape)
        return g, states[-1], loss


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float = 0.01):
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, g: dict[str, np.ndarray], tokens: int, full: int) -> None:
        """A step down sums of gradients over some tokens; windows that hold less than a full number make shorter ones."""
        self.t += 1
        rate, tokens = self.rate * tokens / full, max(1, tokens)
        size = np.sqrt(sum(float((x * x).sum()) for x in g.values())) / tokens
        for k, x in g.items():
            x *= np.float32(min(1.0, 1 / max(size, 1e-9)) / tokens)
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.01 * (x * x - self.v[k])
            self.p[k] -= np.float32(rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)) * self.m[k] / (np.sqrt(self.v[k]) + np.float32(1e-6))


def lanes_of(lengths: np.ndarray, lanes: int) -> list[list[int]]:
    """Texts dealt to lanes, the longest first, each to the lane with the least so far."""
    import heapq

    heap, out = [(0, i) for i in range(lanes)], [[] for _ in range(lanes)]
    for i in np.argsort(-lengths, kind="stable").tolist():
        size, lane = heapq.heappop(heap)
        out[lane].append(i)
        heapq.heappush(heap, (size + int(lengths[i]), lane))
    return out


def windows(net: Network, vocabulary: Vocabulary, numbers: np.ndarray, lengths: np.ndarray, lanes: int, seed: int = 1) -> Iterator[tuple[np.ndarray, ...]]:
    """Windows of texts side by side: (inputs, classes, places, positions in ``numbers`` or -1), each (time, lane); lanes that have ended are left out.

    At a text's first token the input is a beginning, at which the state is one of zeros.
    """
    rng = np.random.default_rng(seed)
    dealt = sorted((own for own in lanes_of(lengths, lanes) if own), key=lambda own: -int(lengths[own].sum()))
    order = np.array([i for own in dealt for i in rng.permutation(own)], np.int64)
    starts, sizes = (np.cumsum(lengths) - lengths)[order], lengths[order]
    begins = np.cumsum(sizes) - sizes
    back = np.repeat((starts - begins).astype(np.int32), sizes)
    back += np.arange(len(numbers), dtype=np.int32)  # lanes one behind the other
    cls, place = vocabulary.units(numbers[back])
    previous = np.empty(len(numbers), np.int16)
    previous[1:] = net.inputs(cls[:-1], place[:-1])
    previous[begins] = net.BEGIN
    spans = np.array([lengths[own].sum() for own in dealt], np.int64)
    first = np.cumsum(spans) - spans
    k, end = 0, int(spans.max(initial=0))
    while k < end:
        open_ = int(np.searchsorted(-spans, -k))
        steps = WINDOW * min(8, len(spans) // open_)  # longer where few lanes are left
        at = k + np.arange(min(steps, end - k))[:, None]
        k += steps
        on = at < spans[:open_]
        where = np.minimum(first[:open_] + at, len(numbers) - 1)
        yield np.where(on, previous[where], net.BEGIN).astype(np.int64), cls[where].astype(np.int64), place[where].astype(np.int64), np.where(on, back[where], -1)


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut where a column's values reach ``most`` bytes or entries; one longer value is a piece alone."""
    for b in batches:
        values = b.column(column)
        ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
            yield b.slice(at, end - at)
            at = end


def numbered(texts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Texts as numbers of tokens, with the base's sums over frequent tokens, and their other tokens, counted; staged, with a number a row."""
    shared, counts, base_all = texts.sparkSession.sparkContext.broadcast(vocabulary.tokens), vocabulary.counts, float(vocabulary.n + vocabulary.v + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, logs = ids_of(shared.value), np.append(np.log10((counts + 1.0) / base_all), 0.0)
        for piece in pieces(batches, "text", CHUNK_BYTES):
            tokens = [tokens_of(t) for t in piece.column("text").to_pylist()]
            lengths = np.array([len(t) for t in tokens])
            ends = np.append(0, np.cumsum(lengths))
            flat = [t for own in tokens for t in own]
            numbers = numbers_of(flat, ids)
            of, known = np.repeat(np.arange(len(tokens)), lengths), numbers >= 0
            rare: list[Counter[bytes]] = [Counter() for _ in tokens]
            for i in np.flatnonzero(~known).tolist():
                rare[of[i]][flat[i]] += 1
            entries = pa.StructArray.from_arrays([pa.array([t for r in rare for t in r], pa.binary()), pa.array([n for r in rare for n in r.values()], pa.int64())], ["token", "n"])
            more = {
                "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(numbers, pa.int32())), "n_tokens": pa.array(lengths, pa.int64()),
                "n_known": pa.array(np.bincount(of, weights=known, minlength=len(tokens)).astype(np.int64)), "base": pa.array(np.bincount(of, weights=logs[np.where(known, numbers, -1)], minlength=len(tokens))),
                "rare": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(r) for r in rare])), pa.int32()), entries),
            }
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("learnt"), *more.values()], ["doc_id", "learnt", *more])

    kind = texts.schema["doc_id"].dataType.simpleString()
    out = texts.mapInArrow(run, f"doc_id {kind}, learnt boolean, ids array<int>, n_tokens long, n_known long, base double, rare array<struct<token:binary,n:long>>")
    return stage_table(out.withColumn("row", F.monotonically_increasing_id()), "recurrent-numbers")  # written, so the rows' numbers stay


def flat_ids(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, texts' lengths) of a piece."""
    ids = piece.column("ids")
    return ids.flatten().to_numpy(zero_copy_only=False), np.diff(np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64))


def lanes_for(tokens: int, texts: int, most: int = 512) -> int:
    return int(np.clip(tokens // (WINDOW * 120), min(16, max(1, texts)), min(most, max(1, texts))))


def trained(rows: DataFrame, start: Network, vocabulary: Vocabulary, rate: float) -> Network:
    """One round: each task goes through its texts from the same parameters; their mean, weighted by tokens."""
    kinds, names = "tokens double, data binary", list(Network.SHAPES)

    def flat(p: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([p[k].ravel() for k in names]).astype(np.float64)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network({k: v.copy() for k, v in start.p.items()})
        adam, seen = Adam(net.p, rate), 0
        for piece in pieces(batches, "ids", CHUNK_TOKENS):
            numbers, lengths = flat_ids(piece)
            lanes = lanes_for(len(numbers), len(lengths))
            h = np.zeros((lanes, HIDDEN), np.float32)
            for x, cls, place, position in windows(net, vocabulary, numbers, lengths, lanes):
                g, h, _ = net.gradients(x, h[: x.shape[1]], cls, place, position >= 0)
                adam.step(g, int((position >= 0).sum()), lanes * WINDOW)
            seen += len(numbers)
        if seen:
            yield pa.RecordBatch.from_pydict({"tokens": [float(seen)], "data": [(flat(net.p) * seen).tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, total = 0.0, None
        for b in batches:
            for n, data in zip(b.column("tokens").to_pylist(), b.column("data"), strict=True):
                part = np.frombuffer(data.as_buffer(), np.float64)
                tokens, total = tokens + n, part.copy() if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"tokens": [tokens], "data": [total.tobytes()]})

    parts = rows.select("ids").mapInArrow(learn, kinds).repartition(4).mapInArrow(add, kinds).collect()  # of fixed size
    if not parts:
        return start
    mean = sum(np.frombuffer(r.data, np.float64) for r in parts) / sum(r.tokens for r in parts)
    out, at = {}, 0
    for k in names:
        size = int(np.prod(Network.SHAPES[k]))
        out[k], at = mean[at : at + size].reshape(Network.SHAPES[k]).astype(np.float32), at + size
    return Network(out)


def fitted(rows: DataFrame, vocabulary: Vocabulary, seed: int = 13) -> Network:
    net = Network.first(vocabulary, seed)
    share, done = F.pmod(F.xxhash64("row"), F.lit(sum(ROUNDS))), 0
    for i, size in enumerate(ROUNDS):
        net = trained(rows.filter(F.col("learnt") & (share >= done) & (share < done + size)), net, vocabulary, 0.02 / (i + 1))
        done += size
    return net


def with_model(rows: DataFrame, net: Network, vocabulary: Vocabulary) -> DataFrame:
    """Rows with ``model``: the sum, over a text's tokens, of log10 of their class and of their share of it, but for the shares of tokens that aren't frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "ids", CHUNK_TOKENS):
            numbers, lengths = flat_ids(piece)
            logs, lanes = vocabulary.tail_log(numbers), lanes_for(len(numbers), len(lengths), 1024)
            h = np.zeros((lanes, HIDDEN), np.float32)
            for x, cls, place, position in windows(net, vocabulary, numbers, lengths, lanes):
                states = net.states(x, h[: x.shape[1]])
                h, on = states[-1], position >= 0
                logs[position[on]] += net.logs(states[on], cls[on], place[on])
            total = np.bincount(np.repeat(np.arange(len(lengths)), lengths), weights=logs, minlength=len(lengths)) / np.log(10)
            yield piece.drop_columns(["ids"]).append_column("model", pa.array(total))

    rows = rows.drop("rare", "learnt")
    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("ids").schema.fields) + ", model double")


def score(docs: DataFrame, training: Column | None = None) -> DataFrame:
    """Scores of ``docs(doc_id, text)`` by a network and counts learnt from the rows that ``training`` picks, by default those not held out."""
    picks = ~held_out(F.col("doc_id")) if training is None else F.coalesce(training, F.lit(False))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"), picks.alias("learnt"))
    counts = stage_table(token_counts(texts.filter("learnt")), "recurrent-counts")
    words = vocabulary(counts)
    rows = numbered(texts, words)
    net = fitted(rows, words.by_number())
    # tokens that aren't frequent: none is more than one in FREQUENT of all
    entries = rows.select("row", F.inline("rare"))
    tails = F.array(*[F.lit(float(x)) for x in words.tails.sum(0) + 1])
    tail = F.crc32(F.when(F.length("token") > 2, F.substring("token", -2, 2)).otherwise(F.col("token"))) % TAILS
    seen = entries.join(broadcast_if_small(counts).hint("shuffle_hash"), "token", "left")
    more = F.coalesce("c", F.lit(0)) + 1.0
    sums = seen.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("known"), F.sum(F.col("n") * F.log10(more / float(words.n + words.v + 1))).alias("base_rare"),
        F.sum(F.col("n") * F.log10(more / F.get(tails, tail.cast("int")))).alias("model_rare"),
    )
    zero = F.lit(0.0)
    return with_model(rows, net, words.by_number()).join(sums, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(words.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_rare", zero)).alias("base_score"), (F.col("model") + F.coalesce("model_rare", zero)).alias("score"),
    )


def op13_recurrent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = score(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
