"""Best-fit-decreasing packing of token sequences into windows.

Documents longer than a window are first cut into full windows. What remains of each is
packed, longest first, into the open window that it fills best; a segment tree over the
remaining capacities finds it. Windows that stay open with a gap are then filled with cut
pieces of the emptiest ones, and what is left at the very end is laid out in sequences whose
lengths are powers of two, which need no padding.

The remains are dealt by hash into shards of about ``per_shard`` documents, each packed on its
own, so the work spreads evenly whatever the documents are and a shard has a bounded size.
Null texts are empty documents (their end token alone). Rows with the same doc_id are packed
one by one. An empty table gives an empty one.
"""

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meterfold.llm.bpe import Pieces, byte_vocabulary, piece_encoder
from meterfold.llm.common import byte_slices, small_batches

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
OUT = PIECE + ", sequence_id long, offset long"
_encoders: dict[str, "TextEncoder"] = {}


class TextEncoder:
    """Token ids of batches of texts; equal pieces are merged once, texts with special strings go to the library whole."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        ids, self.special = byte_vocabulary(path)
        self.encode = piece_encoder(ids)
        self.pieces = Pieces(self._values, 4)

    @staticmethod
    def of(path: str) -> "TextEncoder":
        if path not in _encoders:
            _encoders[path] = TextEncoder(path)
        return _encoders[path]

    def _values(self, found: list[str]) -> list[bytes]:
        return [array("I", self.encode(piece)).tobytes() for piece in found]

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        raw = data.tobytes()
        if not raw or any(s.encode() in raw for s in self.special):
            for a, b in zip(offsets[:-1], offsets[1:]):
                yield np.array(self.library.encode(raw[a:b].decode(), add_special_tokens=False).ids, "<u4")
            return
        places = np.zeros(len(data) + 1, np.int64)
        np.cumsum(data & 0xC0 != 0x80, out=places[1:])
        at = places[offsets]
        _, bounds, which, values = self.pieces.of(raw, np.unique(at[:-1]))
        ids, sizes = self.pieces.joined(which, values, "<u4")
        total = np.append(0, np.cumsum(sizes))
        cuts = total[np.searchsorted(bounds, at)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield ids[a:b]


class OpenWindows:
    """Open windows by remaining capacity, in a segment tree that holds which capacities occur."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.used = [0] * (2 * self.leaves)
        self.windows: dict[int, list[int]] = {}

    def add(self, capacity: int, window: int) -> None:
        self.windows.setdefault(capacity, []).append(window)
        node = self.leaves + capacity
        while node:
            self.used[node] += 1
            node >>= 1

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Takes out (capacity, window) of the smallest capacity of at least ``size``."""
        used, node = self.used, self.leaves + size
        while not used[node]:
            while node & 1:  # a right child: up
                node >>= 1
            if not node:
                return None
            node += 1  # the sibling to the right
            if node & (node - 1) == 0:  # past the last leaf
                return None
        while node < self.leaves:
            node *= 2
            node += not used[node]
        capacity = node - self.leaves
        window = self.windows[capacity].pop()
        while node:
            used[node] -= 1
            node >>= 1
        return capacity, window


def best_fit(sizes: list[int], window: int) -> list[list[int]]:
    """Items by window, for items sorted by falling size."""
    windows, opened = [], OpenWindows(window)
    for item, size in enumerate(sizes):
        found = opened.tightest(size)
        if found is None:
            capacity, w = window, len(windows)
            windows.append([])
        else:
            capacity, w = found
        windows[w].append(item)
        if capacity > size:
            opened.add(capacity - size, w)
    return windows


def arranged(sizes: list[int], window: int, max_gap: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, from, to) for items sorted by falling size."""
    full, gaps = [], []
    for items in best_fit(sizes, window):
        parts = [(i, 0, sizes[i]) for i in items]
        fill = sum(sizes[i] for i in items)
        (full if window - fill <= max_gap else gaps).append((fill, parts))
    gaps.sort(key=lambda x: -x[0])
    done = [parts for _, parts in full]
    low, high = 0, len(gaps) - 1
    spare: list[tuple[int, int, int]] = []  # of the emptiest window, being dealt out
    while low <= high or spare:
        if low > high:
            fill, parts = 0, []
        else:
            fill, parts = gaps[low]
            low += 1
        room = window - fill
        while room:
            if not spare:
                if low > high:
                    break
                spare = gaps[high][1][::-1]
                high -= 1
            i, a, b = spare.pop()
            cut = min(b, a + room)
            parts.append((i, a, cut))
            room -= cut - a
            if cut < b:
                spare.append((i, cut, b))
        if room <= max_gap:
            done.append(parts)
        else:  # the last one
            done += by_powers_of_two(parts, window - room)
    return done


def by_powers_of_two(parts: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    """The parts in order, cut into sequences whose lengths are the powers of two that make up the total."""
    out, rest = [], parts[::-1]
    for bit in range(total.bit_length() - 1, -1, -1):
        room = total & (1 << bit)
        if room:
            out.append([])
        while room:
            i, a, b = rest.pop()
            cut = min(b, a + room)
            out[-1].append((i, a, cut))
            room -= cut - a
            if cut < b:
                rest.append((i, cut, b))
    return out


def pieces(docs: DataFrame, path: str, window: int, end_id: int) -> DataFrame:
    """Full windows with their checksums, and remains with their ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder.of(path)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for row, data, offsets in byte_slices(batch.column("text")):
                out = []
                for k, ids in enumerate(encoder.rows(data, offsets), row):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    n = len(ids)
                    whole = n // window * window
                    for a in range(0, whole, window):
                        out.append((doc_ids[k], a, window, zlib.crc32(ids[a : a + window].tobytes()), n, None))
                    if whole < n:
                        rest = ids[whole:]
                        out.append((doc_ids[k], whole, n - whole, None, n, rest.astype("<u2" if rest.max() < 65536 else "<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 5 + [pa.binary()])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, PIECE + ", ids binary")


def pack(docs: DataFrame, path: str, window: int = 1024, end_id: int = 0, max_gap: int = 8, per_shard: int = 2048) -> DataFrame:
    """One row per piece: its place in its document and in its sequence, and the checksum of its ids."""
    small_batches(docs.sparkSession)
    shards = max(1, -(-docs.count() // per_shard))

    def pack_shard(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["shard", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]).to_pylist(), key=lambda r: (-r["length"], r["doc_id"] is None, r["doc_id"] or 0, r["start"]))
        shard = rows[0]["shard"]
        whole = [r for r in rows if r["ids"] is None]
        rest = [r for r in rows if r["ids"] is not None]
        out = [(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], (shard << 32) + k, 0) for k, r in enumerate(whole)]
        for k, parts in enumerate(arranged([r["length"] for r in rest], window, max_gap), len(whole)):
            offset = 0
            for i, a, b in parts:
                r = rest[i]
                ids = np.frombuffer(r["ids"], "<u2" if len(r["ids"]) == 2 * r["length"] else "<u4").astype("<u4")
                out.append((r["doc_id"], r["start"] + a, b - a, zlib.crc32(ids[a:b].tobytes()), r["doc_tokens"], (shard << 32) + k, offset))
                offset += b - a
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=[x.split()[0] for x in OUT.split(", ")])

    dealt = pieces(docs, path, window, end_id).withColumn("shard", F.pmod(F.xxhash64("doc_id", "start"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(pack_shard, OUT)
