"""Language-model scores from a weighted backoff automaton.

The model is a smoothed n-gram model of any ``order`` over words (white-space separated, A-Z
lowered) and one end token for each text. Every run of fewer than ``order`` words that was
learned is a state. From state h an arc for each gram (h, w) seen has the probability

    P(w | h) = (c(h, w) + t(h) * P(w | h')) / (c(h) + t(h))

with h' the state without h's first word, and leads to the longest state that ends in w. Where
there is no such arc, a failure arc of weight t(h) / (c(h) + t(h)) leads to h'. The last of them
is the state without words, whose arcs are p(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1)). The
strength t(h) is the mean number of different successors of the states of h's length that are
about as frequent as h (by powers of two), so all probabilities of a state add up to one.

A text starts in a state of its own, and one traversal from left to right carries the state
reached and adds up the log10 of all arcs taken, failure arcs included. The texts of a chunk
advance together, one word at a time; long texts are walked in pieces, each from ``order`` - 1
words before its first, after which it is in the very state the whole walk would be in.

All documents with ``learn`` are counted, and no gram is cut off. The model grows with the corpus
and is never in one place: texts are read once and kept as chunks of word numbers with their
vocabulary; words, then pairs, then longer grams, go to the task of their hash range, which adds up the counts
of all chunks and returns to each chunk the counts of what it holds. A word or gram comes once
from each chunk, however frequent it is.

Null texts are empty: the end token alone. Repeated rows count, and are scored, as often as they
occur. Without any row to learn from, every token has the probability 1. Further columns are not
read.
"""

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterfold.llm.common import byte_slices, mix, numbers, small_batches, stored, words_hashed

END, START = (int(x) for x in numbers(2, 101))  # hashes of the end token and of the state before the first word
_A, _B = numbers(2, 103) | np.uint64(1)
CHUNK_TOKENS = 2_000_000
PIECE = 1024  # words of a text walked at a stretch
CLASSES = 64
ENCODED = "chunk long, doc_ids array<long>, learn binary, sizes binary, words binary, vocabulary binary"
PACKED = "range long, chunk long, keys binary, counts binary, kinds binary"
ANSWER = "chunk long, kind int, range long, counts binary, total long, distinct long, by_class array<long>, by_own array<long>"


def planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes first, compressed: high bytes are mostly alike."""
    return zlib.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), 1)


def from_planes(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).reshape(-1).view(kind)


def rising(keys: np.ndarray) -> bytes:
    """Keys in rising order, as differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def from_rising(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, np.uint64), dtype=np.uint64)


def encode(docs: DataFrame) -> DataFrame:
    """Chunks of texts as numbers of the chunk's own vocabulary (hashes in rising order)."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, rows, size = TaskContext.get().partitionId() << 32, [], 0

        def done() -> pa.RecordBatch:
            words = np.concatenate([w for _, _, w in rows])
            vocabulary, ids = np.unique(words, return_inverse=True)
            sizes = np.fromiter((len(w) for _, _, w in rows), np.int64, len(rows))
            learn = np.fromiter((bool(x) for _, x, _ in rows), bool, len(rows))
            packed = planes(ids.astype(np.uint32))
            return pa.RecordBatch.from_arrays(
                [pa.array([chunk]), pa.array([[d for d, _, _ in rows]], pa.list_(pa.int64()))]
                + [pa.array([x], pa.binary()) for x in (learn.tobytes(), sizes.tobytes(), packed, rising(vocabulary))],
                names=[x.split()[0] for x in ENCODED.split(", ")],
            )

        for batch in batches:
            ids, learn = batch.column("doc_id").to_pylist(), batch.column("learn").to_pylist()
            for row, data, offsets in byte_slices(batch.column("text")):
                words, first = words_hashed(data, offsets)
                for k, (a, b) in enumerate(zip(first[:-1], first[1:]), row):
                    rows.append((ids[k], learn[k], np.append(words[a:b], np.uint64(END))))
                    size += b - a + 1
                    if size > CHUNK_TOKENS:
                        yield done()
                        chunk, rows, size = chunk + 1, [], 0
        if rows:
            yield done()

    return docs.mapInArrow(number, ENCODED)


class Texts:
    """A chunk's texts: word numbers, which of them were learned, and where texts begin."""

    def __init__(self, row: dict):
        self.chunk, self.doc_ids = row["chunk"], row["doc_ids"]
        self.vocabulary = from_rising(row["vocabulary"])
        self.ids = from_planes(row["words"], np.uint32).astype(np.int64)
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.learn = np.frombuffer(row["learn"], bool)
        self.learned = np.repeat(self.learn, self.sizes)
        self.first = np.cumsum(self.sizes) - self.sizes

        self.levels: dict[int, tuple] = {}

    def before(self, x: np.ndarray, start) -> np.ndarray:
        """What stands one position earlier; at the beginning of a text ``start``."""
        out = np.roll(x, 1)
        out[self.first] = start
        return out

    def places(self) -> np.ndarray:
        """How many words of its text stand before each."""
        return np.arange(len(self.ids), dtype=np.int32) - np.repeat(self.first.astype(np.int32), self.sizes)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes of the grams of ``k`` words (the start is one) in rising order, the number of the
        gram that ends at each position (one more than there are where a text has not k words yet), and a position of each."""
        if k not in self.levels:
            key, out = self.vocabulary[self.ids], (self.vocabulary, self.ids, None)
            for n in range(2, k + 1):
                key = mix(self.before(key, START if n == 2 else np.uint64(0)) * _A + self.vocabulary[self.ids] * _B)
            if k > 1:
                full = np.flatnonzero(self.places() >= k - 2)
                distinct, where, which = np.unique(key[full], return_index=True, return_inverse=True)
                every = np.full(len(key), len(distinct))
                every[full] = which
                out = distinct, every, full[where]
            self.levels[k] = out
        return self.levels[k]

    def contexts(self, k: int, totals: np.ndarray, starts: int) -> np.ndarray:
        """How often the ``k`` words before each position were learned, from the totals of the grams of k words."""
        numbers = self.before(self.grams(k)[1], len(totals))
        return np.append(totals, starts if k == 1 else 0)[numbers]


def walk(t: Texts, known: np.ndarray, seen: list[np.ndarray], arcs: list[np.ndarray], fails: list[np.ndarray], started: bool) -> np.ndarray:
    """Log-probability of each text, by one traversal that carries the state.

    The state is the number of words of context it stands for; with the position, that names the
    gram. At each position ``arcs[k]`` and ``fails[k]`` are the logarithms of the arc and of the
    failure arc of the state of k words, ``seen[k]`` says whether there is such an arc, and
    ``known`` whether the word was learned.
    """
    longest = len(arcs) - 1
    pieces = -(-t.sizes // PIECE)
    text = np.repeat(np.arange(len(t.sizes)), pieces)
    number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    warm = np.where(number > 0, longest, 0)
    begin = t.first[text] + number * PIECE - warm
    length = np.minimum(t.sizes[text] - number * PIECE, PIECE) + warm
    order = np.argsort(-length, kind="stable")
    text, warm, begin, length = text[order], warm[order], begin[order], length[order]
    state = np.where((begin == t.first[text]) & started, min(1, longest), 0)
    total = np.zeros(len(text))
    active = len(text)
    for step in range(length[0] if len(length) else 0):
        while length[active - 1] <= step:
            active -= 1
        at, now = begin[:active] + step, state[:active]
        gained, reached = np.zeros(active), known[at].astype(np.int64)
        searching = np.ones(active, bool)
        for k in range(longest, 0, -1):
            here = searching & (now >= k)
            hit = here & seen[k][at]
            gained += np.where(hit, arcs[k][at], np.where(here, fails[k][at], 0.0))
            reached[hit] = k + 1
            searching &= ~hit
        gained += np.where(searching, arcs[0][at], 0.0)
        state[:active] = np.minimum(reached, longest)
        total[:active] += np.where(step >= warm[:active], gained, 0.0)
    return np.bincount(text, total, len(t.sizes))


def by_range(chunk: int, keys: np.ndarray, counts: np.ndarray, kinds: np.ndarray, ranges: int) -> Iterator[pa.RecordBatch]:
    """Keys in rising order, cut into ranges of equal width."""
    at = ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    cuts = np.searchsorted(at, np.arange(ranges + 1))
    for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        if b > a:
            parts = [rising(keys[a:b]), zlib.compress(counts[a:b].astype(np.uint32).tobytes(), 1), zlib.compress(kinds[a:b].astype(np.uint8).tobytes(), 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r]), pa.array([chunk])] + [pa.array([x], pa.binary()) for x in parts], names=[x.split()[0] for x in PACKED.split(", ")])


def size_class(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, np.frexp(np.maximum(counts, 1).astype(np.float64))[1], 0).astype(np.uint8)


def totals(kind: int):
    """Adds up a range over all chunks; returns each chunk's keys' totals, and sums over the range with the first."""

    def add(table: pa.Table) -> pa.Table:
        keys = [from_rising(b) for b in table.column("keys").to_pylist()]
        counts = np.concatenate([np.frombuffer(zlib.decompress(b), np.uint32) for b in table.column("counts").to_pylist()])
        distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(which, counts, len(distinct)).astype(np.int64)
        kinds = np.zeros(len(distinct), np.uint8)
        kinds[which] = np.concatenate([np.frombuffer(zlib.decompress(b), np.uint8) for b in table.column("kinds").to_pylist()])
        by_context, by_own = (np.bincount(x[total > 0], minlength=CLASSES).tolist() for x in (kinds, size_class(total)))
        out, at = [], 0
        each = total[which]
        for k in keys:
            out.append(zlib.compress(each[at : at + len(k)].tobytes(), 1))
            at += len(k)
        n = len(keys)
        first = lambda x, rest: [x] + [rest] * (n - 1)
        return pa.Table.from_arrays(
            [table.column("chunk"), pa.array([kind] * n, pa.int32()), table.column("range"), pa.array(out, pa.binary()), pa.array(first(int(total.sum()), 0)),
             pa.array(first(int((total > 0).sum()), 0)), *(pa.array(first(x, None), pa.list_(pa.int64())) for x in (by_context, by_own))],
            names=[x.split()[0] for x in ANSWER.split(", ")],
        )

    return add


def answered(table: pa.Table, kind: int) -> np.ndarray:
    """The totals of a chunk's keys, in order."""
    rows = sorted(((r, c) for r, k, c in zip(*(table.column(x).to_pylist() for x in ("range", "kind", "counts"))) if k == kind))
    return np.concatenate([np.frombuffer(zlib.decompress(c), np.int64) for _, c in rows]) if rows else np.zeros(0, np.int64)


def classes_of(answers: DataFrame, column: str) -> np.ndarray:
    """Sums of ``column`` by class: at most one row for each class reaches the driver."""
    out = np.zeros(CLASSES)
    for r in answers.select(F.posexplode(column).alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[r["k"]] = r["n"]
    return out


def score(docs: DataFrame, order: int = 2) -> DataFrame:
    """doc_id, learn, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text, learn)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("learn", F.lit(False)).alias("learn"))
    ranges = max(8, -(-rows.count() // 8192))
    texts = stored(encode(rows), "texts")

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                t = Texts(row)
                counts = np.bincount(t.ids[t.learned], minlength=len(t.vocabulary))
                yield from by_range(t.chunk, t.vocabulary, counts, np.zeros(len(counts)), ranges)

    counted = [stored(texts.mapInArrow(ask_words, PACKED).groupBy("range").applyInArrow(totals(0), ANSWER), "grams")]
    summed = counted[0].agg(F.sum("total"), F.sum("distinct")).first()
    n, v = summed[0] or 0, summed[1] or 0
    starts = rows.filter("learn").count()

    def ask(k: int):
        """The chunk's grams of ``k`` words, with the size class of the state that each leaves."""

        def fn(left: pa.Table, right: pa.Table) -> pa.Table:
            out = []
            for row in left.to_pylist():
                t = Texts(row)
                keys, which, where = t.grams(k)
                counts = np.bincount(which[t.learned], minlength=len(keys) + 1)[:-1]
                kinds = size_class(t.contexts(k - 1, answered(right, k - 2), starts)[where])
                if k == 2:
                    kinds[t.places()[where] == 0] = 0  # the start is a state of its own
                out += by_range(t.chunk, keys, counts, kinds, ranges)
            return pa.Table.from_batches(out) if out else pa.table({x.split()[0]: pa.array([], pa.int64() if x.endswith("long") else pa.binary()) for x in PACKED.split(", ")})

        return fn

    def chunked(answers: DataFrame, fn, schema: str) -> DataFrame:
        return texts.groupBy("chunk").cogroup(answers.select("chunk", "kind", "range", "counts").groupBy("chunk")).applyInArrow(fn, schema)

    strengths, start_strength = [np.ones(CLASSES)], 1.0
    for k in range(2, order + 1):
        counted.append(stored(chunked(counted[-1], ask(k), PACKED).groupBy("range").applyInArrow(totals(k - 1), ANSWER), "grams"))
        followers, states = classes_of(counted[-1], "by_class"), classes_of(counted[-2], "by_own")
        strengths.append(np.maximum(np.where(states > 0, followers / np.maximum(states, 1), 1.0), 1.0))
        if k == 2:
            start_strength = max(1.0, float(followers[0]))

    def traverse(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            t = Texts(row)
            found = [answered(right, k) for k in range(order)]
            alone = (found[0] + 0.5) / (n + 0.5 * (v + 1)) if n else np.ones(len(found[0]))
            p = alone[t.ids]
            known = (found[0] > 0)[t.ids]
            seen, arcs, fails = [known], [np.log10(p)], [np.zeros(0)]
            for k in range(1, order):  # the states of k words
                often = t.contexts(k, found[k - 1], starts).astype(np.float64)
                weight = strengths[k][size_class(often)]
                if k == 1:
                    weight[t.first] = start_strength
                count = np.append(found[k], 0)[t.grams(k + 1)[1]]
                p = (count + weight * p) / (often + weight)
                seen.append(count > 0)
                arcs.append(np.log10(p))
                fails.append(np.log10(weight / (often + weight)))
            base = np.add.reduceat(arcs[0], t.first)
            t.levels.clear()
            p = often = weight = count = None  # a chunk's arrays are large, and the walk needs none of these
            total = walk(t, known, seen, arcs, fails, starts > 0)
            sure = np.add.reduceat(known.astype(np.int64), t.first)
            out.append(pa.table({"doc_id": pa.array(t.doc_ids, pa.int64()), "learn": pa.array(t.learn), "n_tokens": t.sizes, "n_known": sure, "train_tokens": np.full(len(t.sizes), n), "base_score": base, "score": total}))
        return pa.concat_tables(out)

    answers = reduce(DataFrame.unionByName, counted)
    return chunked(answers, traverse, "doc_id long, learn boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
