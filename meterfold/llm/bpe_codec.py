"""Byte-level BPE encoding by backtracking over longest matches, and decoding by an offset table.

An encoding is right exactly if each of its tokens is one that BPE makes of its own bytes and
BPE leaves every two neighbours apart. So a piece is encoded from left to right: an Aho-Corasick
automaton gives the longest token at every place; it is taken if it may stand behind the token
before it, else the longest token that is a prefix of it is tried. If none fits, the token before
is taken back and the place is marked, so no place is entered twice and the work is linear.

Which tokens may stand side by side is a table over pairs, filled as pairs occur. A pair is
judged by the merges alone: those inside both tokens follow their ranks, and the two stay apart
unless parts that touch at the seam merge before either is merged inside its own token.

Null texts are empty; special strings of the vocabulary inside a text are one token each, the
leftmost first, as the library takes them; other columns are not looked at; repeated rows give
repeated results; an empty table gives an empty one.
"""

import json
import math
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from meterfold.llm.bpe import Pieces, byte_alphabet
from meterfold.llm.common import byte_slices, small_batches

#: Pairs of tokens remembered by a worker; beyond it the table starts anew.
REMEMBERED_PAIRS = 2_000_000
ENCODED = "doc_id long, n_tokens long, ids binary"
DECODED = ENCODED + ", text string"
_codecs: dict[str, "Codec"] = {}


class Vocabulary:
    """Byte strings of all ids, merge ranks, and the special strings of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: bytes(map(alphabet.__getitem__, s)) for s, i in model["vocab"].items() if s not in self.special}
        self.ids = {b: i for i, b in self.bytes.items()}
        if missing := [b for b in range(256) if bytes([b]) not in self.ids]:
            raise ValueError(f"not a byte-level vocabulary: no token for the bytes {missing}")
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        names = {s: i for s, i in model["vocab"].items()}
        #: (left id, right id) -> rank, in the order of the ranks
        self.rank = {(names[a], names[b]): r for r, (a, b) in enumerate(merges)}


class Seams:
    """Whether two tokens stay apart, by the merges that lead to them."""

    def __init__(self, vocabulary: Vocabulary):
        self.rank = vocabulary.rank
        single = [vocabulary.ids[bytes([b])] for b in range(256)]
        #: For a token, the parts that touch its right (left) end, from the byte up, each with the
        #: rank of the merge that uses it up; the token itself lasts.
        self.at_right = {i: [(i, math.inf)] for i in single}
        self.at_left = {i: [(i, math.inf)] for i in single}
        for (a, b), rank in self.rank.items():
            if a not in self.at_right or b not in self.at_left or self.first_merge(a, b) != (a, b):
                continue  # BPE never makes this token of its bytes
            token = vocabulary.ids[vocabulary.bytes[a] + vocabulary.bytes[b]]
            if token not in self.at_right:
                self.at_right[token] = [*self.at_right[b][:-1], (b, rank), (token, math.inf)]
                self.at_left[token] = [*self.at_left[a][:-1], (a, rank), (token, math.inf)]
        self.tokens = list(self.at_right)

    def first_merge(self, a: int, b: int) -> tuple[int, int] | None:
        """The parts of a and b that merge over their seam, or None if a and b stay apart."""
        left, right = self.at_right[a], self.at_left[b]
        i = j = 0
        while True:
            (x, x_used), (y, y_used) = left[i], right[j]
            rank = self.rank.get((x, y), math.inf)
            # Of equal ranks the leftmost merge comes first: inside a, over the seam, inside b.
            if rank < x_used and rank <= y_used:
                return x, y
            if x_used is math.inf and y_used is math.inf:
                return None
            if x_used <= y_used:
                i += 1
            else:
                j += 1


class Encoder:
    """Ids of single pieces."""

    def __init__(self, vocabulary: Vocabulary):
        self.seams = Seams(vocabulary)
        self.size = {i: len(vocabulary.bytes[i]) for i in self.seams.tokens}
        self.whole = {vocabulary.bytes[i]: i for i in self.seams.tokens}
        self.matches = ahocorasick.Automaton()
        for i in self.seams.tokens:
            self.matches.add_word(vocabulary.bytes[i].decode("latin-1"), (i, self.size[i] - 1))
        self.matches.make_automaton()
        #: The longest token that is a proper prefix of a token.
        self.shorter = {i: self._shorter(vocabulary.bytes[i]) for i in self.seams.tokens}
        self.apart: dict[tuple[int, int], bool] = {}

    def _shorter(self, token: bytes) -> int | None:
        return next((self.whole[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in self.whole), None)

    def __call__(self, piece: bytes) -> list[int]:
        token = self.whole.get(piece)
        if token is not None:
            return [token]
        longest = [0] * len(piece)
        for end, (token, back) in self.matches.iter(piece.decode("latin-1")):
            longest[end - back] = token  # matches come by their end, so the last one is the longest
        if len(self.apart) > REMEMBERED_PAIRS:
            self.apart = {}
        apart, size, shorter = self.apart, self.size, self.shorter
        closed = bytearray(len(piece) + 1)  # places from which the rest cannot be encoded
        out, before, at, token = [], None, 0, longest[0]
        while True:
            while token is not None:
                end = at + size[token]
                if not closed[end]:
                    if before is None:
                        break
                    pair = before, token
                    fits = apart.get(pair)
                    if fits is None:
                        fits = apart[pair] = self.seams.first_merge(before, token) is None
                    if fits:
                        break
                token = shorter[token]
            if token is None:  # back to the token before, which must end elsewhere
                closed[at] = 1
                token = out.pop()
                at -= size[token]
                before = out[-1] if out else None
                token = shorter[token]
                continue
            out.append(token)
            if end == len(piece):
                return out
            before, at, token = token, end, longest[end]


class Codec:
    """Encodes and decodes slices of Arrow columns; one for each worker and file."""

    def __init__(self, path: str):
        vocabulary = Vocabulary(path)
        self.encode_piece = Encoder(vocabulary)
        self.pieces = Pieces(self._values, 4)
        self.special = {s.encode(): i for s, i in vocabulary.special.items()}
        by_length = sorted(self.special, key=len, reverse=True)
        self.any_special = re.compile(b"|".join(map(re.escape, by_length))) if by_length else None
        known = vocabulary.bytes | {i: s for s, i in self.special.items()}
        last = max(known)
        #: All byte strings one after the other, and where each id's begins; unknown ids have none.
        self.blob = np.frombuffer(b"".join(known.get(i, b"") for i in range(last + 1)), np.uint8)
        self.offset = np.cumsum([0, *(len(known.get(i, b"")) for i in range(last + 1))])

    @staticmethod
    def of(path: str) -> "Codec":
        if path not in _codecs:
            _codecs[path] = Codec(path)
        return _codecs[path]

    def _values(self, found: list[str]) -> list[bytes]:
        return [array("I", self.encode_piece(piece.encode())).tobytes() for piece in found]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of each row of a slice."""
        raw = data.tobytes()
        if not raw:
            yield from (np.zeros(0, "<u4") for _ in offsets[1:])
            return
        bounds, special = offsets, {}
        if self.any_special and self.any_special.search(raw):
            marks = set(offsets.tolist())
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                for m in self.any_special.finditer(raw[a:b]):
                    special[a + m.start()] = self.special[m[0]]
                    marks |= {a + m.start(), a + m.end()}
            bounds = np.array(sorted(marks)) if special else offsets
        chars = np.zeros(len(data) + 1, np.int64)
        np.cumsum(data & 0xC0 != 0x80, out=chars[1:])
        at = chars[bounds]
        _, starts, which, values = self.pieces.of(raw, np.unique(at[:-1]))
        ids, sizes = self.pieces.joined(which, values, "<u4")
        cuts = np.append(0, np.cumsum(sizes))[np.searchsorted(starts, at)]
        if not special:
            for a, b in zip(cuts[:-1], cuts[1:]):
                yield ids[a:b]
            return
        first = np.searchsorted(bounds, offsets)
        for a, b in zip(first[:-1], first[1:]):
            parts = [np.full(1, special[s], "<u4") if (s := int(bounds[k])) in special else ids[cuts[k] : cuts[k + 1]] for k in range(a, b)]
            yield np.concatenate(parts) if parts else ids[:0]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters, unknown ids nothing."""
        ids = ids[ids < len(self.offset) - 1].astype(np.int64)
        sizes = self.offset[ids + 1] - self.offset[ids]
        begin = np.cumsum(sizes) - sizes
        where = np.repeat(self.offset[ids] - begin, sizes) + np.arange(int(sizes.sum()))
        return self.blob[where].tobytes().decode("utf-8", "replace")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and ids: little-endian unsigned 32-bit numbers, one after the other."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for batch in batches:
            for row, data, offsets in byte_slices(batch.column("text")):
                found = list(codec.encode(data, offsets))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(row, len(found)).cast(pa.int64()),
                    pa.array(list(map(len, found)), pa.int64()),
                    pa.array([x.tobytes() for x in found], pa.binary()),
                ], names=["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Rows of ``encode`` with their text again; null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for batch in batches:
            for at in range(0, len(batch), 100):
                part = batch.slice(at, 100)
                texts = [codec.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "n_tokens", "ids")), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "text"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, DECODED)
