"""Near-duplicate vectors of equal label, by a subspace pigeonhole join.

Unit vectors of cosine c are 2 - 2c apart, squared. All are rotated (random signs and a
Hadamard transform, which spreads their weight evenly) and cut into ``blocks`` blocks; two
vectors within the squared distance must be within its proportional share in one block at
least. In each block a range join on its first coordinate, in slices as wide as the share,
brings such pairs together; inside a slice a second coordinate and the block's distance leave
the candidates, and each is verified exactly on the whole vectors in double precision. A pair
is counted in the first block in which it qualifies, so every link counts once.

A vector is a member of its own slice and asks in the next one. The vectors of every slice are
counted, and one with more than ``chunk`` of them is dealt out over chunks of about that many;
every two chunks meet in one task, so neither a hot label nor a dense slice is one task, and
the others are sent once for a block and once to ask. Equal vectors are one class with a
multiplicity. Tasks return link counts and a spanning forest of their links, never the pairs.

Vectors that are null, empty or zero, that hold null or non-finite components, or have a null
label link with nothing. Vectors of different lengths link with nothing either. Repeated rows
(same id, label and vector) are one vector. Further columns are not read.
"""

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterfold.llm.common import numbers, small_batches, stored
from meterfold.llm.components import components

SLACK = 1e-9
PAIRS = 40_000  # verified at once
ROWS = 512  # compared at once with a slice


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def rotated(vectors: np.ndarray, blocks: int) -> np.ndarray:
    """The same for a vector wherever it stands: only element-wise sums. Padded to a power of two."""
    n = max(blocks, 1 << max(0, (vectors.shape[1] - 1).bit_length()))
    x = np.zeros((len(vectors), n))
    x[:, : vectors.shape[1]] = vectors
    for seed in (3, 4):
        x = x * np.where(numbers(n, seed) >> np.uint64(63) == 1, 1.0, -1.0)
        step = 1
        while step < n:
            y = x.reshape(len(x), -1, 2, step)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
            step *= 2
        x /= sqrt(n)
    return x


class Links:
    """Verified links among the vectors of one task."""

    def __init__(self, vectors: np.ndarray, weight: np.ndarray, blocks: int, block: int, threshold: float):
        self.unit = unit(vectors)
        self.turned = rotated(self.unit, blocks)
        self.blocks, self.block, self.threshold = blocks, block, threshold
        self.budget = (2 - 2 * threshold) / blocks + SLACK
        wide = self.turned.shape[1] // blocks
        self.part = self.turned[:, block * wide : (block + 1) * wide]
        self.weight, self.count = weight, np.zeros(len(vectors), np.int64)
        self.label = np.arange(len(vectors))

    def verify(self, i: np.ndarray, j: np.ndarray) -> None:
        for k in range(0, len(i), PAIRS):
            a, b = i[k : k + PAIRS], j[k : k + PAIRS]
            gap = self.turned[a] - self.turned[b]
            shares = (gap * gap).reshape(len(a), self.blocks, -1).sum(2)
            first = (shares[:, self.block] <= self.budget) & ~(shares[:, : self.block] <= self.budget).any(1)
            a, b = a[first], b[first]
            near = (self.unit[a] * self.unit[b]).sum(1) >= self.threshold
            a, b = a[near], b[near]
            self.count += np.bincount(a, self.weight[b], len(self.count)).astype(np.int64)
            self.count += np.bincount(b, self.weight[a], len(self.count)).astype(np.int64)
            while (self.label[a] != self.label[b]).any():
                low = np.minimum(self.label[a], self.label[b])
                np.minimum.at(self.label, self.label[a], low)
                np.minimum.at(self.label, self.label[b], low)
                self.label = self.label[self.label]

    def between(self, rows: np.ndarray, others: np.ndarray, same: bool) -> None:
        """Pairs of rows and others (the same set: each pair once) that the block lets through."""
        axis = min(1, self.part.shape[1] - 1)
        width = sqrt(self.budget)
        others = others[np.argsort(self.part[others, axis], kind="stable")]
        sorted_by = self.part[others, axis]
        rows = rows[np.argsort(self.part[rows, axis], kind="stable")]
        for k in range(0, len(rows), ROWS):
            some = rows[k : k + ROWS]
            low = np.searchsorted(sorted_by, self.part[some[0], axis] - width)
            high = np.searchsorted(sorted_by, self.part[some[-1], axis] + width, "right")
            near = others[low:high]
            if not len(near):
                continue
            x, y = self.part[some], self.part[near]
            apart = (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T)
            i, j = np.nonzero(apart <= self.budget + SLACK)
            i, j = some[i], near[j]
            if same:
                once = i < j
                i, j = i[once], j[once]
            self.verify(i, j)


def crowded(placed: DataFrame, chunk: int) -> DataFrame:
    """_label, _rep, _k1 and _dealt: of a vector's places (block * 2 + 1 where it asks), those in slices of several chunks."""
    spots = placed.select("_label", "_size", "_rep", "_k1", F.posexplode("_slices").alias("_block", "_own"))
    spots = spots.withColumn("_probe", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_slice", F.col("_own") + F.col("_probe"))
    keys = ["_label", "_size", "_block", "_slice"]
    dense = spots.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("_chunks")).filter("_chunks > 1")
    place = F.struct((F.col("_block") * 2 + F.col("_probe")).alias("place"), "_chunks")
    return spots.join(dense, keys).groupBy("_label", "_rep", "_k1").agg(F.collect_set(place).alias("_dealt"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, blocks: int = 8, chunk: int = 16_384) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector (vec_id, embedding, label)."""
    small_batches(vectors.sparkSession)
    width = sqrt((2 - 2 * threshold) / blocks + SLACK)
    rows = vectors.select(F.col("vec_id").cast("long"), "label", F.col("embedding").cast("array<double>").alias("_v")).distinct()
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("_v") > 0) & finite & F.exists("_v", lambda x: x != 0)
    keyed = rows.withColumn("_ok", F.coalesce(usable, F.lit(False))).withColumns({"_k1": F.xxhash64("_v"), "_k2": F.xxhash64(F.lit(5), "_v")})
    keyed = stored(keyed, "vectors")
    classes = keyed.filter("_ok").groupBy("label", "_k1", "_k2").agg(F.min("vec_id").alias("_rep"), F.count(F.lit(1)).alias("_many"), F.first("_v").alias("_v"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = batch.column("_v").flatten().to_numpy(zero_copy_only=False), np.diff(batch.column("_v").offsets.to_numpy())
            begin = np.cumsum(sizes) - sizes
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                v = np.ascontiguousarray(flat[begin[at][:, None] + np.arange(size)])
                turned = rotated(unit(v), blocks)
                first = np.floor(turned[:, :: turned.shape[1] // blocks] / width).astype(np.int64)[:, :blocks]
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_label"), pa.array(np.full(len(at), size, np.int32)), part.column("_rep"), part.column("_k1"), part.column("_many"),
                     pa.array(list(first), pa.list_(pa.int64())), pa.array([x.tobytes() for x in v], pa.binary())],
                    names=["_label", "_size", "_rep", "_k1", "_many", "_slices", "_bytes"],
                )

    placed = classes.select(F.col("label").cast("string").alias("_label"), "_rep", "_k1", "_many", "_v").mapInArrow(
        place, "_label string, _size int, _rep long, _k1 long, _many long, _slices array<long>, _bytes binary"
    )
    placed = stored(placed, "places")
    ready = placed.join(crowded(placed, chunk), ["_label", "_rep", "_k1"], "left")
    dealt = ready.select("*", F.posexplode("_slices").alias("_block", "_own")).withColumn("_probe", F.explode(F.array(F.lit(0), F.lit(1))))
    here = F.col("_block") * 2 + F.col("_probe")
    chunks = F.coalesce(F.get(F.filter("_dealt", lambda x: x["place"] == here), F.lit(0))["_chunks"], F.lit(1))
    dealt = dealt.withColumn("_slice", F.col("_own") + F.col("_probe")).withColumn("_chunks", chunks)
    dealt = dealt.withColumn("_chunk", F.pmod(F.xxhash64("_rep"), F.col("_chunks")).cast("int"))
    # The vectors of a chunk go with those of each chunk of their slice.
    spread = dealt.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    spread = spread.withColumns({"_lo": F.least("_chunk", "_j"), "_hi": F.greatest("_chunk", "_j")})
    group = ["_label", "_size", "_block", "_slice", "_lo", "_hi"]

    def link(table: pa.Table) -> pa.Table:
        probe = table.column("_probe").to_numpy() == 1
        ids, weight, chunks = (table.column(c).to_numpy() for c in ("_rep", "_many", "_chunk"))
        out = [np.zeros(0, np.int64)] * 3
        if len(ids) > 1 and not probe.all():
            data = np.frombuffer(b"".join(table.column("_bytes").to_pylist()), np.float64).reshape(len(ids), -1)
            lo, hi = table.column("_lo")[0].as_py(), table.column("_hi")[0].as_py()
            found = Links(data, weight, blocks, table.column("_block")[0].as_py(), threshold)
            members, asking = ({c: np.flatnonzero((probe == p) & (chunks == c)) for c in (lo, hi)} for p in (False, True))
            found.between(members[lo], members[hi], lo == hi)
            for a, b in {(lo, hi), (hi, lo)}:
                found.between(asking[a], members[b], False)
            at = np.flatnonzero(found.count)
            out = [ids[at], ids[found.label[at]], found.count[at]]
        return pa.Table.from_arrays([pa.array(x) for x in out], names=["a", "b", "n"])

    found = stored(spread.select(*group, "_rep", "_many", "_chunk", "_probe", "_bytes").groupBy(*group).applyInArrow(link, "a long, b long, n long"), "links")
    counts = found.groupBy(F.col("a").alias("_rep")).agg(F.sum("n").alias("_n"))
    roots = components(found.select("a", "b"))
    reps = classes.select("label", "_k1", "_k2", "_rep", "_many").join(counts, "_rep", "left").join(roots.withColumnRenamed("node", "_rep"), "_rep", "left")
    reps = reps.select("label", "_k1", "_k2", (F.col("_many") - 1 + F.coalesce("_n", F.lit(0))).alias("_links"), F.coalesce("root", "_rep").alias("_root"))
    good = keyed.filter("_ok").select("vec_id", "label", "_k1", "_k2").join(reps, ["label", "_k1", "_k2"]).select("vec_id", "_links", "_root")
    rest = keyed.filter("NOT _ok").select("vec_id", F.lit(0).cast("long").alias("_links"), F.col("vec_id").alias("_root"))
    both = good.unionByName(rest)
    return both.select("vec_id", F.col("_links").alias("n_links"), F.col("_root").alias("component_id"), (F.col("vec_id") == F.col("_root")).alias("kept"))
