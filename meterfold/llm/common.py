"""Helpers shared by the operators: tables, scratch tables, hashed words of Arrow batches.

Words are hashed in bulk: every byte gets a fixed random 64-bit number, a running sum of
(number times r to the power of the position) is kept, and a word's hash is the difference
of two sums, shifted back to position 0 and mixed. Equal words have equal hashes wherever
they stand; two different words meet with a probability of about 2**-64.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterfold.session import scratch_path

R = np.uint64(0x9E3779B97F4A7C15)
R_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SLICE_BYTES = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return small_batches(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> SparkSession:
    """Texts are long, so Arrow batches hold few rows; a worker's memory stays bounded."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: lineage ends there, lost executors cost nothing."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(col):
    """A-Z in lower case, other letters as they are; pure ASCII takes Spark's fast path."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def remainder(id_col, n: int):
    return F.crc32(F.col(id_col).cast("string")) % n


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbers(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * R + np.uint64(seed))


_BYTE = numbers(256, 11)
_BYTE[65:91] = _BYTE[97:123]
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r and its inverse to the powers 0 to n, modulo 2**64."""
    if len(_powers[0]) < n + 1:
        for k, base in enumerate((R, R_INVERSE)):
            p = np.full(n + 1, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def spans_hashed(numbered: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of every span [start, end) of a sequence of numbers."""
    up, down = powers(len(numbered))
    total = np.zeros(len(numbered) + 1, np.uint64)
    np.cumsum(numbered * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def byte_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of a string array of about ``most`` bytes (one row at least): (first row, bytes, offsets)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and the first word of each row (one more at the end)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_WHITE[data]
    starts = inside[1:] & ~inside[:-1]  # at i: byte i begins a word
    ends = inside[:-1] & ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    touching = cut[inside[cut] & inside[cut + 1]]
    starts[touching] = ends[touching] = True
    start, end = np.flatnonzero(starts), np.flatnonzero(ends)
    return start, end, np.searchsorted(start, offsets)


def words_hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lowered) of all rows, and the first word of each row."""
    start, end, first = word_spans(data, offsets)
    return spans_hashed(_BYTE[data], start, end), first


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` word hashes."""
    total = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k, factor in enumerate(numbers(n, 77) | np.uint64(1)):
        total += words[k : k + len(total)] * factor
    return mix(total + np.uint64(n))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles of ``n`` words (fewer words: one shingle)."""
    words, first = words_hashed(data, offsets)
    all_grams = grams(words, n)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= n:
            yield np.unique(all_grams[a : b - n + 1])
        else:
            yield grams(words[a:b], b - a) if b > a else np.zeros(0, np.uint64)
