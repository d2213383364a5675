"""Language identification with string kernels.

A text is the set of its character n-grams (n = 1 to 3, the blended spectrum, presence only)
after lowering; what is no letter counts as a blank. The kernel of two texts is the cosine of
their sets. Nyström features come from the kernel with a number of landmark texts, and
one-versus-rest kernel ridge regression is fitted on them. Scoring is one matrix product a
batch: the texts' presence matrix times the landmarks' presence matrix, features and
regression weights, which are multiplied beforehand.

Every language that labels a row is learned. Fitting uses a bounded sample: of each language
``per_language`` labelled rows, those of the smallest hash of doc_id (and text), ``landmarks``
of them as landmarks, and the ``most_grams`` n-grams that most of its landmarks hold. With more
than ``full`` languages each one's share shrinks, down to 16 rows, 4 landmarks and 300 n-grams.
Of a sampled text with more than ``row_grams`` n-grams those of the smallest hash are learned
from. Only n-gram sets of the sample reach the driver. Everything is scored, whole.

Null texts and texts without a letter are ``und`` with score 0; rows with a null language
teach nothing; without any labelled row all texts are ``und``. Ties go to the language that
comes first in the alphabet. Repeated rows are scored alike.
"""

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterfold.llm.common import byte_slices, mix, small_batches

UNKNOWN = "und"
BITS = 21  # of a code point
_letters: list[np.ndarray] = []
_tables: dict[int, tuple] = {}


def letters() -> np.ndarray:
    """Code point to its lower-case letter, or 0."""
    if not _letters:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if unicodedata.category(chr(c))[0] == "L":
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 else c
        _letters.append(table)
    return _letters[0]


def lowered(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters (0: none) of all texts, each after a blank, and where the texts begin."""
    points = letters()[np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
    places = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data & 0xC0 != 0x80, out=places[1:])
    at = places[offsets]
    # A blank between texts keeps their n-grams apart.
    out = np.zeros(len(points) + len(at) - 1, np.uint32)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    out[np.arange(len(points)) + row + 1] = points
    return out, at + np.arange(len(at))


def gram_set(points: np.ndarray) -> np.ndarray:
    """Distinct codes of the 1-, 2- and 3-grams, without those of blanks alone."""
    p = points.astype(np.uint64)
    b = np.uint64(BITS)
    two = p[:-1] << b | p[1:]
    three = two[:-1] << b | p[2:]
    tag = np.uint64(1 << 63)  # 3-grams; 1- and 2-grams differ by their letters
    out = np.unique(np.concatenate([p, two[p[:-1] > 0], three | tag]))
    return out[(out != 0) & (out != tag)]


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # codes of the landmarks' n-grams
    weights: np.ndarray  # grams x languages: landmarks, features and regression folded together
    sharpness: float


def places(grams: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Where each code stands in the sorted ``grams``; their number if it does not."""
    at = np.searchsorted(grams, found)
    at[at == len(grams)] = 0
    return np.where(grams[at] == found, at, len(grams)) if len(grams) else np.zeros(len(found), np.int64)


def fit_sets(names: list[str], sets: list[np.ndarray], landmarks: int, most_grams: int, ridge: float, sharpness: float) -> Model:
    """Fits on gram sets; ``landmarks`` texts and ``most_grams`` n-grams come from each language."""
    languages = sorted(set(names))
    own: dict[str, list[int]] = {lang: [] for lang in languages}
    for k, name in enumerate(names):
        own[name].append(k)
    chosen = [k for lang in languages for k in own[lang][:landmarks]]
    kept = []
    for lang in languages:  # a small language's n-grams do not compete with a large one's
        codes, count = np.unique(np.concatenate([sets[k] for k in own[lang][:landmarks]]), return_counts=True)
        kept.append(codes[np.lexsort((codes, -count))[:most_grams]])
    grams = np.unique(np.concatenate(kept))

    held = [places(grams, x) for x in sets]
    held = [x[x < len(grams)] for x in held]
    scale = np.array([1 / np.sqrt(max(1, len(x))) for x in held])
    # Which landmarks hold each gram: the kernel of a text with all landmarks adds up its grams' lists.
    listed = np.concatenate([held[k] for k in chosen])
    holder = np.repeat(np.arange(len(chosen)), [len(held[k]) for k in chosen])[np.argsort(listed, kind="stable")]
    ends = np.searchsorted(np.sort(listed), np.arange(len(grams) + 1))

    def kernel(k: int) -> np.ndarray:
        begin, size = ends[held[k]], ends[held[k] + 1] - ends[held[k]]
        at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(holder[at], minlength=len(chosen)) * scale[chosen] * scale[k]

    values, vectors = np.linalg.eigh(np.array([kernel(k) for k in chosen]))
    keep = values > 1e-6
    nystroem = vectors[:, keep] / np.sqrt(values[keep])
    features = np.array([kernel(k) for k in range(len(sets))]) @ nystroem
    target = np.array([[1.0 if n == lang else -1.0 for lang in languages] for n in names])
    # Each language weighs the same, however many rows it has in the sample.
    weight = 1 / (target > 0).sum(0)[[languages.index(n) for n in names]]
    weighted = features * weight[:, None]
    solved = nystroem @ np.linalg.solve(features.T @ weighted + ridge * np.eye(features.shape[1]), weighted.T @ target)
    weights = np.zeros((len(grams), len(languages)))
    for m, k in enumerate(chosen):
        weights[held[k]] += scale[k] * solved[m]
    return Model(languages, grams, weights.astype(np.float32), sharpness)


def fit(
    docs: DataFrame, per_language: int = 250, landmarks: int = 40, most_grams: int = 4_000, full: int = 16,
    row_grams: int = 8_000, ridge: float = 1e-3, sharpness: float = 6.0,
) -> Model:
    """Learns from ``docs`` (doc_id, text, lang)."""
    small_batches(docs.sparkSession)
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    keyed = labelled.select("lang", F.xxhash64("doc_id", F.lit(1)).alias("h"), "doc_id").distinct()
    share = min(1.0, full / max(1, labelled.select("lang").distinct().count()))
    rows_each, landmarks, most_grams = max(16, int(per_language * share)) if share < 1 else per_language, max(4, int(landmarks * share)), max(300, int(most_grams * share))
    first = keyed.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id")))
    picked = [r["doc_id"] for r in first.filter(F.col("k") <= rows_each).select("doc_id").distinct().collect()]
    if not picked:
        return Model([], np.zeros(0, np.uint64), np.zeros((0, 0), np.float32), sharpness)

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, data, offsets in byte_slices(batch.column("text")):
                points, at = lowered(data, offsets)
                for a, b in zip(at[:-1], at[1:]):
                    codes = gram_set(np.append(points[a:b], np.uint32(0)))
                    if len(codes) > row_grams:
                        codes = np.sort(codes[np.argsort(mix(codes), kind="stable")[:row_grams]])
                    found.append(codes.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array(found, pa.binary())], names=["lang", "h", "grams"])

    # An id may stand on many rows, so the rows are bounded once more.
    texts = labelled.filter(F.col("doc_id").isin(picked)).select("lang", "text", F.xxhash64("doc_id", "text").alias("h")).dropDuplicates(["lang", "h"])
    sample = texts.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("k") <= rows_each)
    rows = sample.select("lang", "text", "h").mapInArrow(sets_of, "lang string, h long, grams binary").collect()
    rows = [r for r in sorted(rows, key=lambda r: (r["h"], r["lang"])) if r["grams"]]
    if not rows:
        return Model([], np.zeros(0, np.uint64), np.zeros((0, 0), np.float32), sharpness)
    return fit_sets([r["lang"] for r in rows], [np.frombuffer(r["grams"], np.uint64) for r in rows], landmarks, most_grams, ridge, sharpness)


class Scorer:
    """The model with a last column for all other n-grams."""

    def __init__(self, model: Model):
        self.grams = model.grams
        self.weights = np.concatenate([model.weights, np.zeros((1, model.weights.shape[1]), np.float32)])
        self.rows = max(1, 2_400_000 // len(self.weights))  # texts in one presence matrix
        # Most n-grams of other scripts are told by their letters alone.
        self.known = np.zeros(0x110000, bool)
        for k in range(3):
            letter = model.grams >> np.uint64(BITS * k) & np.uint64((1 << BITS) - 1)
            self.known[letter.astype(np.int64)] = True

    def scores(self, points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margins of all languages for each text, and whether it has a letter."""
        n = len(at) - 1
        row = np.repeat(np.arange(n), np.diff(at))
        known = np.append(self.known[points], [True, True])
        p = np.append(points, np.zeros(2, np.uint32)).astype(np.uint64)
        two = p[:-1] << np.uint64(BITS) | p[1:]
        three = two[:-1] << np.uint64(BITS) | p[2:] | np.uint64(1 << 63)
        last = np.zeros(len(row) + 1, bool)
        last[at[1:]] = True  # a 3-gram from a text's last letter on would reach into the next text
        present = np.zeros((n, len(self.weights)), np.float32)
        one = known[:-2] & (points > 0)
        pair = one & known[1:-1]
        triple = known[:-2] & known[1:-1] & known[2:] & ~last[1:]
        for use, codes in ((one, p[:-2]), (pair, two[:-1]), (triple, three)):
            present[row[use], places(self.grams, codes[use])] = 1
        present[:, -1] = 0
        size = np.sqrt(np.maximum(1, present.sum(1, keepdims=True)))
        lettered = np.bincount(row[points > 0], minlength=n) > 0
        return present @ self.weights / size, lettered


def predict(docs: DataFrame, model: Model, keep: bool = False) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) of every row; the text alone is read.

    With ``keep``, the columns of ``docs`` go along as the struct ``given`` instead of doc_id.
    """
    small_batches(docs.sparkSession)
    key = hash((tuple(model.languages), model.grams.tobytes(), model.weights.tobytes()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _tables and model.languages:
            _tables.clear()
            _tables[key] = Scorer(model)
        for batch in batches:
            texts = batch.column("text")
            for row, data, offsets in byte_slices(texts, 1 << 19):
                n = len(offsets) - 1
                langs, best = [UNKNOWN] * n, np.zeros(n)
                if model.languages:
                    parts = []
                    points, at = lowered(data, offsets)
                    step = _tables[key].rows
                    for a in range(0, n, step):
                        b = min(n, a + step)
                        parts.append(_tables[key].scores(points[at[a] : at[b]], at[a : b + 1] - at[a]))
                    margin = np.concatenate([p[0] for p in parts])
                    lettered = np.concatenate([p[1] for p in parts])
                    odds = np.exp(model.sharpness * (margin - margin.max(1, keepdims=True)))
                    odds /= odds.sum(1, keepdims=True)
                    which = margin.argmax(1)
                    langs = [model.languages[w] if ok else UNKNOWN for w, ok in zip(which, lettered)]
                    best = np.where(lettered, odds[np.arange(n), which], 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("given").slice(row, n), pa.array(langs), pa.array(best.astype(np.float64))], names=["given", "lang_pred", "score"])

    given = F.struct(*docs.columns) if keep else F.struct(F.col("doc_id").cast("long").alias("doc_id"))
    read = docs.select(given.alias("given"), "text")
    schema = T.StructType([read.schema["given"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    scored = read.mapInArrow(score, schema)
    return scored if keep else scored.select("given.doc_id", "lang_pred", "score")
