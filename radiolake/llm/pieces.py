"""N-best segmentation of texts into the pieces of a public SentencePiece vocabulary, and back.

A segmentation's score is the sum of its pieces' scores. Forward Viterbi scores of the piece
lattice are the exact best score of every prefix; an A* search that runs backward from the end
with those scores as heuristic therefore completes segmentations in order of score.

No piece reaches across a space that follows another character, or across a character that no
multi-character piece has, so a text's lattice falls apart into small lattices of its chunks. The
best segmentation and the loss of the second best are found for all new chunks of a batch at once,
position by position in numpy; a text's N best differ only at the N - 1 chunks with the smallest
loss, and only those are searched with A*.

The vocabulary is read on the driver and sent with the task; its size is that of the file, not of
the data. A task's memory of known chunks is bounded by ``MEMORY``.

Defined cases: spaces become the sign for a space and a text starts with one, as the vocabulary
expects; a character without a piece, and a literal space sign, becomes its UTF-8 bytes' pieces, so
decoding gives back every text exactly; a null text gives null pieces, an empty one none; a run of
characters without white space of any length is one chunk, whose search is bounded by its length;
of equal scores, the best has the longer last piece in the first chunk that differs;
other columns pass through, columns named like an output are replaced.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from radiolake.llm.shared import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
LONGEST_BATCHED = 48
MEMORY = 400_000
SLICE_CHARS = 1_000_000
N_BEST = 4
NONE = -(1 << 60)
CHUNK = re.compile(r" *[^ \n\t]+|[\n\t]| +")


class Vocabulary:
    """Pieces, scores and byte pieces of a SentencePiece model file."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.pieces = {model.id_to_piece(i): (i, int(model.get_score(i))) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        self.byte_ids = {int(model.id_to_piece(i)[1:-1], 16): i for i in ids if model.is_byte(i)}
        if len(self.byte_ids) < 256:
            raise ValueError("the vocabulary has no byte pieces")
        if wrong := [p for p in self.pieces if SPACE in p.lstrip(SPACE) or len(p) > 1 and re.search(r"[\n\t ]", p)]:
            raise ValueError(f"pieces reach across the chunks' edges: {wrong[:5]!r}")
        self.longest = max(map(len, self.pieces))
        self.unknown = min(s for _, s in self.pieces.values() if s > -(10**8)) - 10
        self.bytes = [b""] * len(ids)
        for p, (i, _) in self.pieces.items():
            self.bytes[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte_ids.items():
            self.bytes[i] = bytes([b])

    def marked(self, chunk: str) -> str:
        """Spaces as the space sign; a literal space sign as a character that has no piece."""
        return chunk.replace(SPACE, "￿").replace(" ", SPACE)

    def ids_of(self, chunk: str, marked: str, start: int, end: int) -> list[int]:
        if (found := self.pieces.get(marked[start:end])) is not None:
            return [found[0]]
        return [self.byte_ids[b] for b in chunk[start:end].encode()]

    def decode(self, ids) -> str:
        out = b"".join([self.bytes[i] for i in ids])
        return out[1:].decode() if out else ""


def forward(v: Vocabulary, marked: str) -> list[int]:
    """Best score of each prefix."""
    best = [0]
    for end in range(1, len(marked) + 1):
        best.append(max(score for score, _ in arcs_into(v, marked, best, end)))
    return best


def arcs_into(v: Vocabulary, marked: str, best: list[int], end: int) -> list[tuple[int, int]]:
    """(best score through it, start) of the arcs that end at a position: best first, of equal ones the longer."""
    out = []
    for start in range(max(0, end - v.longest), end):
        found = v.pieces.get(marked[start:end])
        if found is not None or start == end - 1:
            out.append((best[start] + (found[1] if found is not None else v.unknown), start))
    return sorted(out, key=lambda x: -x[0])


def n_best(v: Vocabulary, chunk: str, n: int) -> list[tuple[int, list[int]]]:
    """The ``n`` best (score, ids) of a chunk, by backward A* over its lattice.

    An entry of the agenda is an arc: a suffix from where it ends, continued by the arc. Once it is
    popped, the next best arc into the same end follows. As the ``n`` best suffixes at a position have
    the ``n`` best prefixes to complete them, no position is expanded more than ``n`` times; and of
    equal scores the one nearest the start goes first, so that ties are not searched breadth first.
    Time and memory thus grow with the chunk's length times ``n``.
    """
    marked = v.marked(chunk)
    best = forward(v, marked)
    if not marked:
        return [(0, [])]
    out, order, expanded = [], 0, {}
    arcs: dict[int, list[tuple[int, int]]] = {}
    agenda: list[tuple] = []  # -(prefix + suffix), start, order, suffix's score, index of the arc, cuts from its end on

    def push(suffix: int, k: int, cuts: tuple) -> None:
        nonlocal order
        end = cuts[0]
        if end not in arcs:
            arcs[end] = arcs_into(v, marked, best, end)
        if k < len(arcs[end]):
            through, start = arcs[end][k]
            order += 1
            heapq.heappush(agenda, (-(through + suffix), start, order, suffix, k, cuts))

    push(0, 0, (len(marked), None))
    while agenda and len(out) < n:
        total, start, _, suffix, k, cuts = heapq.heappop(agenda)
        push(suffix, k + 1, cuts)
        if start:
            if expanded.get(start, 0) < n:
                expanded[start] = expanded.get(start, 0) + 1
                push(-total - best[start], 0, (start, cuts))
            continue
        ids = []
        while cuts is not None:
            end, cuts = cuts
            ids += v.ids_of(chunk, marked, start, end)
            start = end
        out.append((-total, ids))
    return out


class Segmenter:
    """Best segmentations of many chunks at once, remembered up to ``MEMORY`` chunks."""

    def __init__(self, v: Vocabulary):
        self.v = v
        rng = np.random.default_rng(1)
        self.base = np.uint64(int(rng.integers(1 << 62)) * 2 + 1)
        self.powers = [np.uint64(pow(int(self.base), k, 1 << 64)) for k in range(v.longest + 1)]
        self.tables = {}
        for k in {len(p) for p in v.pieces}:
            have = [(p, *at) for p, at in v.pieces.items() if len(p) == k]
            h = self.hashes(np.array([list(map(ord, p)) for p, *_ in have], np.uint64))[:, k]
            order = np.argsort(h)
            self.tables[k] = h[order], np.array([s for *_, s in have])[order]
        self.forget()

    def forget(self):
        self.at: dict[str, int] = {}
        self.score, self.loss, self.first, self.count, self.ids, self.n_ids, self.others = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), 0, {}

    def hashes(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
        for i in range(codes.shape[1]):
            mixed = (codes[:, i] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            out[:, i + 1] = out[:, i] * self.base + (mixed ^ (mixed >> np.uint64(29)))
        return out

    def _viterbi(self, marked: list[str], size: int):
        """Of chunks of one length: best and second best score, and the last arc at each position."""
        codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).reshape(len(marked), size).astype(np.uint64)
        h = self.hashes(codes)
        one, two = np.full((size + 1, len(marked)), NONE), np.full((size + 1, len(marked)), NONE)
        one[0], last = 0, np.zeros((size + 1, len(marked)), np.int8)
        for end in range(1, size + 1):
            for k in range(min(end, self.v.longest), 0, -1):
                if k not in self.tables:
                    continue
                keys, scores = self.tables[k]
                own = h[:, end] - h[:, end - k] * self.powers[k]
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                hit = keys[at] == own
                if k > 1 and not hit.any():
                    continue
                s = np.where(hit, scores[at], self.v.unknown if k == 1 else NONE)
                a, b = one[end - k] + s, two[end - k] + s
                better = a > one[end]
                two[end] = np.maximum(np.maximum(two[end], b), np.minimum(one[end], a))
                one[end] = np.maximum(one[end], a)
                last[end][better] = k
        return one[size], two[size], last

    def learn(self, chunks: list[str]) -> None:
        by_size: dict[int, list[str]] = {}
        for c in chunks:
            by_size.setdefault(min(len(c), LONGEST_BATCHED + 1), []).append(c)
        ids, counts, score, loss = [], [], [], []
        for size, group in by_size.items():
            if size > LONGEST_BATCHED:
                for c in group:
                    found = n_best(self.v, c, 2)
                    ids += found[0][1]
                    counts.append(len(found[0][1]))
                    score.append(found[0][0])
                    loss.append(found[0][0] - found[1][0] if len(found) > 1 else 1 << 60)
            else:
                marked = [self.v.marked(c) for c in group]
                one, two, last = self._viterbi(marked, size)
                for c, m, steps in zip(group, marked, last.T.tolist(), strict=True):
                    end, own = size, []
                    while end:
                        start = end - steps[end]
                        own = self.v.ids_of(c, m, start, end) + own
                        end = start
                    ids += own
                    counts.append(len(own))
                score += one.tolist()
                loss += np.where(two > NONE // 2, one - two, 1 << 60).tolist()
            for c in group:
                self.at[c] = len(self.at)
        counts = np.array(counts, np.int64)
        self.first = np.concatenate([self.first, self.n_ids + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.score, self.loss = np.concatenate([self.score, np.array(score, np.int64)]), np.concatenate([self.loss, np.array(loss, np.int64)])
        self.ids = np.concatenate([self.ids, np.array(ids, np.int32)])
        self.n_ids += len(ids)

    def alternatives(self, chunk: str, n: int) -> list[tuple[int, list[int]]]:
        if chunk not in self.others:
            self.others[chunk] = n_best(self.v, chunk, n)
        return self.others[chunk]

    def encode(self, texts: list[str], n: int) -> list[list[tuple[int, np.ndarray]]]:
        """The ``n`` best (score, ids) of each text."""
        split = [CHUNK.findall(" " + t) if t else [] for t in texts]
        new = {c for cs in split for c in cs} - self.at.keys()
        if len(self.at) + len(new) > MEMORY and self.at:
            self.forget()
            new = {c for cs in split for c in cs}
        if new:
            self.learn(sorted(new))
        return [self._text(cs, n) for cs in split]

    def _text(self, chunks: list[str], n: int) -> list[tuple[int, np.ndarray]]:
        if not chunks:
            return [(0, np.zeros(0, np.int32))]
        at = np.fromiter(map(self.at.__getitem__, chunks), np.int64, len(chunks))
        first, count = self.first[at], self.count[at]
        ends = np.cumsum(count)
        ids = self.ids[np.repeat(first - ends + count, count) + np.arange(ends[-1])]
        score, loss = int(self.score[at].sum()), self.loss[at]
        out = [(score, ids)]
        if n == 1:
            return out
        # stable: of equal losses the earlier chunk
        few = np.arange(len(at)) if len(at) < n else np.flatnonzero(loss <= np.partition(loss, n - 2)[n - 2])
        few = sorted(few[np.argsort(loss[few], kind="stable")][: n - 1].tolist())
        mixes = [(0, ())]
        for i in few:
            if loss[i] < 1 << 60:
                other = self.alternatives(chunks[i], n)
                mixes = sorted((lost + other[0][0] - s, (*took, (i, j)) if j else took) for lost, took in mixes for j, (s, _) in enumerate(other))[:n]
        for lost, took in mixes[1:]:
            parts, done = [], 0
            for i, j in took:
                parts += [ids[done : ends[i] - count[i]], np.array(self.alternatives(chunks[i], n)[j][1], np.int32)]
                done = ends[i]
            out.append((score - lost, np.concatenate([*parts, ids[done:]])))
        return out


def encode(docs: DataFrame, n: int = N_BEST, model: str = MODEL) -> DataFrame:
    """Add to ``docs(text, ...)``:

    ``ids`` of the best segmentation, ``nbest`` (score, n_pieces, crc32 of the ids as little-endian
    32-bit integers) of the ``n`` best, and ``decoded``, whether the pieces decode to the text.
    """
    v = Vocabulary(model)
    names = [c for c in docs.columns if c not in ("ids", "nbest", "decoded")]
    docs = docs.select(*names)
    out_type = "ids array<int>, nbest array<struct<score:bigint,n_pieces:int,crc32:bigint>>, decoded boolean"
    best_type = pa.list_(pa.struct([("score", pa.int64()), ("n_pieces", pa.int32()), ("crc32", pa.int64())]))
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(v)
        for batch in batches:
            lo = 0
            texts = batch.column(at).to_pylist()
            while lo < len(texts):
                hi, chars = lo, 0
                while hi < len(texts) and (hi == lo or chars < SLICE_CHARS):
                    chars += len(texts[hi] or "")
                    hi += 1
                some = texts[lo:hi]
                ids, best, same = [], [], []
                for text, found in zip(some, segmenter.encode(some, n), strict=True):
                    ids.append(found[0][1])
                    best.append(None if text is None else [{"score": s, "n_pieces": len(x), "crc32": zlib.crc32(x.tobytes())} for s, x in found])
                    same.append(None if text is None else v.decode(found[0][1].tolist()) == text)
                lengths = np.fromiter(map(len, ids), np.int64, len(ids))
                ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)), mask=pa.array([t is None for t in some]))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(best, best_type), pa.array(same, pa.bool_())], names=[*names, "ids", "nbest", "decoded"])
                lo = hi

    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(out_type).fields])
    return docs.mapInArrow(run, schema)


def op8_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
