"""The prefix trie of conversations, from the sorted order of their turn sequences.

A conversation becomes a key of 20 bytes for each turn (a hash of role and text, and the text's
length), so that a shared prefix is a shared prefix of keys. Equal keys are one class. Classes
are range-partitioned and sorted by key, and the tree of each partition comes from the lengths of
the common prefixes (LCP) of neighbours: these edges are taken in descending depth, union-find
joins the components on both sides, and every merge makes (or widens) a branching node at that
depth. The nodes between two branchings are the turns on the way, expanded at the end.

Partitions know the LCP with the partitions beside them. Nodes that reach over a border are prefixes
of a partition's first or last key; each partition contracts its forest to partial sums for them
(a node and a child are counted where they first occur), which one aggregation merges. All other
nodes are final. So a partition holds a bounded number of classes whatever the conversations share.

Members that end at a node are hashed in order of id: ids are gathered by ranges of 1,024, and
the ranges of a class stream through one digest, so a class of any size needs little memory.

Turns are ordered by number (null first), then role and text; null roles and texts are empty.
Repeated rows are turns of their own. Rows without conv_id belong to no conversation. A
conversation travels as one row of 20 bytes a turn. Other columns are not looked at. An empty
table has no nodes, not even a root.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterfold.llm.common import small_batches, stored
from meterfold.session import checkpointed

UNIT = 20  # bytes of a key for each turn: 16 of a hash, 4 of the text's length
RANGE_BITS = 10
#: A range partition holds about this many bytes of keys and this many classes.
PARTITION_BYTES, PARTITION_CLASSES = 16 << 20, 50_000
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
NODE = (
    "pid int, node binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string"
)


def _joined_key(units: Column) -> Column:
    return F.unhex(F.array_join(units, ""))


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id and key of every conversation.

    Only hashes are shuffled. Where two turns of a conversation have the same number and role but
    different texts, their order needs the texts, so those conversations are ordered once more.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    unit = F.concat(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)), F.lpad(F.hex(F.octet_length(text)), 8, "0"))
    given = turns.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), "turn", role.alias("role"), text.alias("text"), unit.alias("unit"))
    in_order = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", "role", "unit")))
    found = given.groupBy("conv_id").agg(in_order.alias("turns"))
    size = F.size("turns") - 1
    tied = F.exists(
        F.zip_with(F.slice("turns", 1, size), F.slice("turns", 2, size), lambda x, y: x["turn"].eqNullSafe(y["turn"]) & (x["role"] == y["role"]) & (x["unit"] != y["unit"])),
        lambda x: x,
    )
    own = stored(found.select("conv_id", _joined_key(F.transform("turns", lambda x: x["unit"])).alias("key"), tied.alias("tied")), "turns")
    clear = own.filter("NOT tied").select("conv_id", "key")
    unclear = own.filter("tied").select("conv_id")
    if unclear.isEmpty():
        return clear
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    placed = given.join(unclear, "conv_id", "left_semi").select("conv_id", place.alias("place"), "unit")
    again = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "unit"))).alias("turns"))
    return clear.unionByName(again.select("conv_id", _joined_key(F.transform("turns", lambda x: x["unit"])).alias("key")))


def rebuilt(found: DataFrame, every: int = 5, most: int = 8) -> DataFrame:
    """Conversations that begin like the one whose id is theirs cut down to a multiple of ``every``.

    The first h turns are taken from it, h being a hash of the id up to ``most``; the own turns
    follow after the first h.
    """
    h = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int") * UNIT
    first = found.select(F.col("conv_id").alias("base"), F.substring("key", 1, most * UNIT).alias("first"))
    own = found.select("conv_id", "key", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), h.alias("h"))
    begin = F.coalesce(F.substring(F.col("first"), F.lit(1), F.col("h")), F.lit(b""))
    rest = F.substring(F.col("key"), F.col("h") + 1, F.greatest(F.octet_length("key") - F.col("h"), F.lit(0)))
    return own.join(first, "base", "left").select("conv_id", F.concat(begin, rest).alias("key"))


def ends_digests(members: DataFrame) -> DataFrame:
    """For each class the SHA-256 of its members' ids, ascending, joined by commas."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    ranges = members.groupBy("class", F.shiftright("conv_id", RANGE_BITS).alias("range")).agg(ids.alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            names, digests = [], []
            for name, ids in zip(batch.column("class").to_pylist(), batch.column("ids").to_pylist()):
                if name != current:
                    if current is not None:
                        names.append(current)
                        digests.append(state.hexdigest())
                    current, state = name, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(digests, pa.string())], names=["class", "ends"])
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], pa.binary()), pa.array([state.hexdigest()])], names=["class", "ends"])

    streams = ranges.repartition("class").sortWithinPartitions("class", "range").select("class", "ids")
    return streams.mapInArrow(digest, "class binary, ends string")


def common_turns(a: bytes, b: bytes) -> int:
    """Turns at the begin of two keys that are the same."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return int(differ[0] if len(differ) else n) // UNIT


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last key of a partition."""
    first = last = None
    for batch in batches:
        if len(batch):
            keys = batch.column("key")
            first = keys[0].as_py() if first is None else first
            last = keys[-1].as_py()
    if first is not None:
        pid = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([first], pa.binary()), pa.array([last], pa.binary())], names=["pid", "first", "last"])


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared = [common_turns(a, b) for a, b in zip(batch.column("last").to_pylist(), batch.column("next_first").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("pid"), batch.column("next_pid"), pa.array(shared, pa.int64())], names=["pid", "next_pid", "shared"])


def borders(dealt: DataFrame) -> dict[int, list[int]]:
    """Turns that a partition shares with the one before and the one after it (-1: there is none).

    One pair of numbers for each partition reaches the driver.
    """
    ends = dealt.select("key").mapInArrow(_ends, "pid int, first binary, last binary")
    in_order = Window.orderBy("pid")  # one row for each partition
    pairs = ends.select("pid", "last", F.lead("pid").over(in_order).alias("next_pid"), F.lead("first").over(in_order).alias("next_first"))
    found: dict[int, list[int]] = {}
    for row in pairs.filter("next_pid IS NOT NULL").mapInArrow(_seams, "pid int, next_pid int, shared long").collect():
        found.setdefault(row.pid, [-1, -1])[1] = row.shared
        found.setdefault(row.next_pid, [-1, -1])[0] = row.shared
    return found


def _neighbours(units: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Common turns of each sequence with the one before it (from the second one on)."""
    both = np.minimum(size[:-1], size[1:])
    shared = both.copy()
    some = np.flatnonzero(both)
    if len(some):
        n = both[some]
        begin = np.cumsum(n) - n
        k = np.arange(int(n.sum())) - np.repeat(begin, n)
        a, b = np.repeat(start[:-1][some], n) + k, np.repeat(start[1:][some], n) + k
        differ = (units[a] != units[b]).any(axis=1)
        shared[some] = np.minimum.reduceat(np.where(differ, k, np.repeat(n, n)), begin)
    return shared


class Forest:
    """The nodes over the sorted, distinct sequences of one partition.

    ``left`` and ``right`` are the turns shared with the sequences beside the partition. A node
    k spans the sequences low[k] to high[k] and stands for all depths from bottom[k] to depth[k].
    """

    def __init__(self, size: np.ndarray, bytes_until: np.ndarray, start: np.ndarray, least: list[int], members: list[int], shared: np.ndarray, left: int, right: int):
        m = len(size)
        self.left, self.right, self.until, self.start = left, right, bytes_until, start
        depth = size.tolist()
        self.depth, self.bottom, self.up = depth[:], [0] * m, [-1] * m
        self.low, self.high = list(range(m)), list(range(m))
        self.least, self.members = least[:], members[:]
        after = np.append(shared, right)
        self.leaves = (after < size).astype(np.int64).tolist()
        self.children, self.below, self.end = [0] * m, [0] * m, list(range(m))
        group = list(range(m))  # union-find over sequences
        extent = [1] * m
        top = list(range(m))  # the highest node of a component

        def find(x: int) -> int:
            while group[x] != x:
                group[x] = x = group[group[x]]
            return x

        edges = np.argsort(-shared, kind="stable")
        for i, at in zip((edges + 1).tolist(), shared[edges].tolist()):
            a, b = find(i - 1), find(i)
            over = top[a] if self.depth[top[a]] == at else self._branch(top[a], at)
            self._hang(top[b], over)
            if extent[a] < extent[b]:
                a, b = b, a
            group[b], top[a] = a, over
            extent[a] += extent[b]
        root = top[find(0)]
        self.root = root if self.depth[root] == 0 else self._branch(root, 0)

    def _branch(self, child: int, depth: int) -> int:
        """A new node over one child."""
        node = len(self.depth)
        self.depth.append(depth)
        for column, value in ((self.bottom, 0), (self.up, -1), (self.low, self.low[child]), (self.high, self.low[child] - 1), (self.least, self.least[child]), (self.members, 0), (self.leaves, 0), (self.children, 0), (self.below, 0), (self.end, -1)):
            column.append(value)
        self._hang(child, node)
        return node

    def _hang(self, child: int, over: int) -> None:
        """Puts a node below another, to its right."""
        at = self.depth[over]
        low, n = self.low[child], self.members[child]
        self.bottom[child], self.up[child] = at + 1, over
        known = max(at, min(self.depth[child], self.left)) if low == 0 else at  # turns up to here began in an earlier partition
        begin, until = self.start[low], self.until
        own = n * int(until[begin + self.depth[child]] - until[begin + at]) - int(until[begin + self.depth[child]] - until[begin + known])
        self.below[over] += self.below[child] + own
        self.children[over] += known == at
        self.high[over] = self.high[child]
        self.least[over] = min(self.least[over], self.least[child])
        self.members[over] += n
        self.leaves[over] += self.leaves[child]

    def nodes(self) -> dict[str, np.ndarray]:
        """One entry for every depth of every node."""
        depth, bottom, up, low, high, least, members, leaves, children, below, end = (
            np.array(x, np.int64) for x in (self.depth, self.bottom, self.up, self.low, self.high, self.least, self.members, self.leaves, self.children, self.below, self.end)
        )
        last = int(high[self.root])
        count = depth - bottom + 1
        k = np.repeat(np.arange(len(depth)), count)
        begin = np.cumsum(count) - count
        d = depth[k] - (np.arange(int(count.sum())) - begin[k])  # from the node's depth upwards
        deepest, highest = d == depth[k], d == bottom[k]
        begun = (low[k] == 0) & (d <= self.left)  # also in an earlier partition
        until = self.until[self.start[low[k]] + d]
        size = np.where(d > 0, until - self.until[self.start[low[k]] + np.maximum(d - 1, 0)], 0)
        own = (members[k] - ~begun) * size
        running = np.cumsum(own)
        saved = below[k] + running - (running - own)[begin][k]
        above = np.where(highest, up[k], k)  # the node that the next depth up belongs to

        def reach(node: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            real = node >= 0
            return real & (low[node] == 0) & (at <= self.left), real & (high[node] == last) & (at <= self.right)

        return {
            "depth": d, "least": least[k], "members": members[k], "leaves": leaves[k], "saved": saved,
            "children": np.where(deepest, children[k], 1 - ((low[k] == 0) & (d + 1 <= self.left))),
            "end": np.where(deepest, end[k], -1), "up": above, "up_least": least[above],
            "open": reach(k, d), "up_open": reach(above, d - 1),
        }


def _prefixes(key: bytes, most: int) -> list[bytes]:
    """Hashes of the first 0 to ``most`` turns."""
    state, found = hashlib.md5(), [hashlib.md5().digest()]
    for k in range(most):
        state.update(key[k * UNIT : (k + 1) * UNIT])
        found.append(state.digest())
    return found


def _grow(seams: dict[int, list[int]]):
    """mapInArrow function: the nodes of a sorted partition. Nodes over a border have a name, theirs or their parent's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = [b for b in batches if len(b)]
        if not given:
            return
        pid = TaskContext.get().partitionId()
        left, right = seams.get(pid, (-1, -1))
        keys, least, members, ends = (sum((b.column(c).to_pylist() for b in given), []) for c in ("key", "conv_id", "n", "ends"))
        size = np.fromiter(map(len, keys), np.int64, len(keys)) // UNIT
        start = np.cumsum(size) - size
        raw = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, UNIT)
        until = np.append(0, np.cumsum(np.ascontiguousarray(raw[:, 16:]).view(">u4").ravel().astype(np.int64)))
        forest = Forest(size, until, start, least, members, _neighbours(raw, start, size), left, right)
        found = forest.nodes()
        first, last = _prefixes(keys[0], max(left, 0)), _prefixes(keys[-1], max(right, 0))

        def names(open_left, open_right, depth):
            return [first[d] if a else last[d] if b else None for a, b, d in zip(open_left.tolist(), open_right.tolist(), depth.tolist())]

        n = len(found["depth"])
        for at in range(0, n, 10_000):
            cut = slice(at, at + 10_000)
            d, up = found["depth"][cut], found["up"][cut]
            parents = names(*(x[cut] for x in found["up_open"]), d - 1)
            known = (up >= 0) & np.array([p is None for p in parents])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(d), pid, np.int32)), pa.array(names(*(x[cut] for x in found["open"]), d), pa.binary()), pa.array(parents, pa.binary()),
                pa.array(found["least"][cut]), pa.array(d), pa.array(found["up_least"][cut], mask=~known), pa.array(found["members"][cut]),
                pa.array(found["children"][cut]), pa.array(found["leaves"][cut]), pa.array(found["saved"][cut]),
                pa.array([ends[e] if e >= 0 else None for e in found["end"][cut].tolist()], pa.string()),
            ], names=[x.split()[0] for x in NODE.split(", ")])

    return run


def trie(members: DataFrame, per_partition: int = PARTITION_CLASSES) -> DataFrame:
    """All nodes of the conversations ``members`` (conv_id, key); a range partition takes about ``per_partition`` classes.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    (bytes of turns stored once instead of once a member, over the subtree) and ends_sha256.
    """
    small_batches(members.sparkSession)
    members = stored(members.withColumn("class", F.unhex(F.md5("key"))), "members")
    classes = members.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).withColumn("class", F.unhex(F.md5("key")))
    classes = stored(classes.join(ends_digests(members), "class").drop("class"), "classes")
    total = classes.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0)).alias("bytes")).first()
    parts = 1 + total.bytes // PARTITION_BYTES + total.n // per_partition
    dealt = checkpointed(classes.repartitionByRange(parts, "key").sortWithinPartitions("key"))
    nodes = stored(dealt.mapInArrow(_grow(borders(dealt)), NODE), "nodes")

    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    partial = nodes.filter("node IS NOT NULL")
    merged = stored(partial.groupBy("node", "parent", "depth").agg(F.min("conv_id").alias("conv_id"), *sums, F.max("ends_sha256").alias("ends_sha256")), "open")
    least = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("_least"))
    # A partition's nodes meet the nodes over its own borders, so a root with many children is one key for each partition.
    here = partial.select("pid", F.col("node").alias("parent")).join(least, "parent")
    inner = nodes.filter("node IS NULL").join(here, ["pid", "parent"], "left")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    whole = inner.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_least")).select(*columns)
    over = merged.join(least, "parent", "left").withColumnRenamed("_least", "parent_conv_id").select(*columns)
    return whole.unionByName(over).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)))


# The nodes of the rebuilt conversations in DuckDB's SQL; the reduction is CRC-32, bit by bit.
SQL = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS txt,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, CAST(conv_id AS VARCHAR) AS s FROM (SELECT DISTINCT conv_id FROM turns)),
hashed AS (
  SELECT conv_id, base, xor(CAST(4294967295 AS BIGINT), list_reduce(
    list_concat([CAST(4294967295 AS BIGINT)], range(0, 8 * length(s))),
    lambda x, k: xor((CASE WHEN k % 8 = 0 THEN xor(x, CAST(ascii(s[k // 8 + 1]) AS BIGINT)) ELSE x END) >> 1,
      3988292384 * ((CASE WHEN k % 8 = 0 THEN xor(x, CAST(ascii(s[k // 8 + 1]) AS BIGINT)) ELSE x END) & 1)))) % 9 AS h
  FROM ids),
made AS (
  SELECT h.conv_id, 0 AS part, t.place, t.role, t.txt FROM hashed h JOIN turns t ON t.conv_id = h.base AND t.place <= h.h
  UNION ALL
  SELECT h.conv_id, 1, t.place, t.role, t.txt FROM hashed h JOIN turns t ON t.conv_id = h.conv_id AND t.place > h.h),
numbered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS d, role, txt FROM made),
prefixes AS (
  SELECT conv_id, d, strlen(txt) AS bytes, list(md5(strlen(role) || ':' || role || txt)) OVER (PARTITION BY conv_id ORDER BY d) AS turns
  FROM numbered
  UNION ALL SELECT conv_id, 0, 0, [] FROM ids),
named AS (
  SELECT conv_id, d, bytes, md5(array_to_string(turns, ',') || '/' || d) AS node,
    CASE WHEN d > 0 THEN md5(coalesce(array_to_string(turns[1:d - 1], ','), '') || '/' || (d - 1)) END AS parent,
    max(d) OVER (PARTITION BY conv_id) AS depth
  FROM prefixes),
nodes AS (
  SELECT node, any_value(parent) AS parent, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    (count(*) - 1) * any_value(bytes) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = depth), '')) AS ends_sha256
  FROM named GROUP BY node),
children AS (SELECT parent, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
under AS (
  SELECT a.node, count(*) FILTER (WHERE c.n IS NULL) AS n_leaves, sum(n.saved) AS saved_tokens
  FROM nodes n LEFT JOIN children c ON c.parent = n.node JOIN named a ON a.conv_id = n.conv_id AND a.d <= n.depth
  GROUP BY a.node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
  u.n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN children c ON c.parent = n.node JOIN under u ON u.node = n.node
"""
