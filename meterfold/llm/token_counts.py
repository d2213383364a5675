"""Exact token counts of texts and of all their prefixes, by prefix dynamic programming.

``token_counts`` gives each document's count and, for every budget asked for, the longest
prefix (in code points) that fits; with ``tables=True`` also the counts of all prefixes, so
that ``tokens_at`` and ``longest_fit`` answer later questions without encoding anything.

Null texts count as empty (0 tokens); other columns are not looked at; repeated rows give
repeated results; an empty table gives an empty one. Special strings of the vocabulary inside
a text are one token, as the library takes them by default; prefixes that end inside such a
string are ordinary text.
"""

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterfold.llm.bpe import CONTRACTIONS, SPACE, Pieces, PrefixCounter, classes
from meterfold.llm.common import byte_slices, small_batches

_counters: dict[str, "TextCounter"] = {}


class TextCounter:
    """Counts of every prefix of a batch of texts."""

    def __init__(self, path: str):
        self.program = PrefixCounter(path)
        self.pieces = Pieces(self._values, 4)
        self.blanks: dict[str, int] = {}
        by_length = sorted(self.program.special, key=len, reverse=True)
        self.any_special = re.compile("|".join(map(re.escape, by_length))) if by_length else None

    @staticmethod
    def of(path: str) -> "TextCounter":
        if path not in _counters:
            _counters[path] = TextCounter(path)
        return _counters[path]

    def _values(self, found: list[str]) -> list[bytes]:
        out = [c.tobytes() for c in self.program.counts(found)]
        for k, piece in enumerate(found):
            if len(piece) == 3 and piece in CONTRACTIONS:  # its first two characters are no contraction, so two pieces
                out[k] = out[k][:4] + np.uint32(2).tobytes() + out[k][8:]
        return out

    def _white_run(self, run: str) -> int:
        if run not in self.blanks:
            if len(self.blanks) > 100_000:
                self.blanks.clear()
            self.blanks[run] = int(self.program.counts([run])[0][-1])
        return self.blanks[run]

    def plain(self, data: bytes, breaks: np.ndarray) -> np.ndarray:
        """For each code point, the tokens of its text up to and with it; no special strings."""
        if not data:
            return np.zeros(0, np.int64)
        text, bounds, which, values = self.pieces.of(data, breaks)
        inner, sizes = self.pieces.joined(which, values, np.uint32)
        totals = np.frombuffer(b"".join(v[-4:] for v in values), np.uint32)[which].astype(np.int64)
        before = np.cumsum(totals) - totals
        counts = np.repeat(before, sizes) + inner
        # A prefix that ends with a run of white space has that whole run as its last piece.
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        white = classes()[points] == SPACE
        breaks = breaks[breaks < len(points)]
        first = np.zeros(len(points), bool)
        first[breaks] = True
        after = np.append(white[:-1] & ~white[1:] & ~first[1:], False)
        inside = after.copy()
        inside[1:] &= white[:-1]
        inside[0] = False
        inside &= ~first
        for e in np.flatnonzero(inside).tolist():
            a = e
            while a > 0 and white[a - 1] and not first[a]:
                a -= 1
            counts[e] = before[np.searchsorted(bounds, a)] + self._white_run(text[a : e + 1])
        base = np.zeros(len(breaks), np.int64)
        base[1:] = before[np.searchsorted(bounds, breaks[1:])]
        return counts - np.repeat(base, np.diff(np.append(breaks, len(points))))

    def one(self, text: str) -> np.ndarray:
        """The counts of all prefixes of one text, which may hold special strings; the leftmost is a token, then the longest."""
        found, at, total = [], 0, 0
        for m in self.any_special.finditer(text) if self.any_special else ():
            # Prefixes that end inside the special string are ordinary text.
            seen = self.plain((text[at : m.start()] + m[0][:-1]).encode(), np.zeros(1, np.int64))
            found.append(total + seen)
            total += (int(seen[m.start() - at - 1]) if m.start() > at else 0) + 1
            found.append(np.full(1, total))
            at = m.end()
        if at < len(text):
            found.append(total + self.plain(text[at:].encode(), np.zeros(1, np.int64)))
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of all prefixes of all rows one after the other, and where the rows begin."""
        raw = data.tobytes()
        if any(s.encode() in raw for s in self.program.special):
            parts = [self.one(raw[a:b].decode()) for a, b in zip(offsets[:-1], offsets[1:])]
            return np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        places = np.zeros(len(data) + 1, np.int64)
        np.cumsum(data & 0xC0 != 0x80, out=places[1:])
        at = places[offsets]
        return self.plain(raw, np.unique(at[:-1])), at


def packed(counts: np.ndarray) -> bytes:
    """A prefix table: the differences of neighbouring counts, compressed."""
    return zlib.compress(np.diff(counts, prepend=0).astype("<i2").tobytes(), 1)


def tokens_at(table: bytes, length: int) -> int:
    """Tokens of the first ``length`` code points."""
    return int(np.frombuffer(zlib.decompress(table), "<i2")[:length].sum())


def longest_fit(table: bytes, budget: int) -> int:
    """The longest prefix, in code points, of at most ``budget`` tokens."""
    fits = np.flatnonzero(np.cumsum(np.frombuffer(zlib.decompress(table), "<i2"), dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def token_counts(docs: DataFrame, path: str, budgets: tuple[int, ...] = (), tables: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, fit_<budget> for each budget and, if asked for, prefix_counts."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_bytes long, n_tokens long" + "".join(f", fit_{b} long" for b in budgets) + ", prefix_counts binary" * tables

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TextCounter.of(path)
        for batch in batches:
            for row, data, offsets in byte_slices(batch.column("text")):
                counts, at = counter.rows(data, offsets)
                full = np.flatnonzero(np.diff(at))
                n = len(offsets) - 1
                tokens = np.zeros(n, np.int64)
                tokens[full] = counts[at[full + 1] - 1]
                out = [batch.column("doc_id").slice(row, n).cast(pa.int64()), pa.array(np.diff(offsets)), pa.array(tokens)]
                for budget in budgets:
                    fit = np.zeros(n, np.int64)
                    if len(full):
                        last = np.maximum.reduceat(np.where(counts <= budget, np.arange(1, len(counts) + 1), 0), at[full])
                        fit[full] = np.maximum(0, last - at[full])
                    out.append(pa.array(fit))
                if tables:
                    out.append(pa.array([packed(counts[a:b]) for a, b in zip(at[:-1], at[1:])], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(count, schema)


def over_limit(counted: DataFrame, limit: int) -> DataFrame:
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
