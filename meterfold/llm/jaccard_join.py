"""Documents whose word-shingle sets have a Jaccard similarity of at least a threshold.

Exact, by a token-group matrix over groups of similar documents:

1. Equal sets are one class. Of every class the share of its tokens that another class holds
   too is counted; a class that has more tokens of its own than the threshold allows is similar
   to nothing. One half of the token universe is enough for that test. Tokens travel packed by
   ranges, and only counts come back.
2. The classes that are left are grouped: documents with a common min-hash sketch are compared
   with the sketch's smallest document, and links make groups. Those of which enough tokens
   stand in other groups are compared once more, by single min-hashes.
3. The matrix holds the token union of every group, in parts of at most about ``part`` members
   of about one size. A document asks only if enough of its tokens stand in other groups. It is
   sent to the parts of a possible size in which one of its rarest tokens is among a member's
   rarest: as many as must contain a common one, given both sizes, groups being counted. There its overlap with
   the part's union bounds the similarity; the part is opened, and its members compared, only if
   the bound reaches the threshold.

A group of near copies is linked through its smallest members and never compared all with all.
Components are those of the links found, which connect exactly what all links would.

Null texts, and texts without words, have an empty set and link with nothing; rows with a null
doc_id link with nothing. Texts of fewer words than a shingle are one shingle. Repeated rows are
members of one class. Further columns are not read.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterfold.llm.common import byte_slices, mix, numbers, shingle_sets, small_batches, stored
from meterfold.llm.components import components

SKETCHES, MINIMA = 4, 3
SINGLES = 8
CHUNK_TOKENS = 1_000_000
_SEEDS = numbers(SKETCHES * MINIMA, 31)
_SINGLE_SEEDS = numbers(SINGLES, 37)
SET = "doc_id long, n long, d1 long, d2 long"


def least_common(n: int, percent: int) -> int:
    """Tokens that a set of n must share with any similar one."""
    return -(-n * percent // 100)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def digest(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set from others, whatever the order."""
    return tuple(int(mix(tokens * s).sum(dtype=np.uint64).view(np.int64)) for s in (_SEEDS[0] | np.uint64(1), _SEEDS[1] | np.uint64(1)))


def sketches(tokens: np.ndarray) -> list[int]:
    lows = [int(mix(tokens ^ s).min()) for s in _SEEDS]
    return [hash(tuple(lows[k : k + MINIMA])) for k in range(0, len(lows), MINIMA)]


def minima(tokens: np.ndarray) -> list[int]:
    return [int(mix(tokens ^ s).min().view(np.int64)) for s in _SINGLE_SEEDS]


def sets_of(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        for row, data, offsets in byte_slices(batch.column("text")):
            yield from zip(ids[row:], shingle_sets(data, offsets, words))


class Chunk:
    """Sets of some documents, to be sent out by token range."""

    def __init__(self):
        self.rows, self.tokens, self.size = [], [], 0

    def add(self, row: tuple, owner: int, tokens: np.ndarray) -> None:
        self.rows.append((*row, owner))
        self.tokens.append(tokens)
        self.size += len(tokens)

    def batches(self, number: int, ranges: int, half: bool) -> Iterator[pa.RecordBatch]:
        """A row for each range: chunk, tokens (32 bits), tokens of each document, owners; the documents with the first."""
        sizes = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        tokens = np.concatenate(self.tokens)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        if half:
            keep = tokens < np.uint64(1 << 63)
            tokens, doc = tokens[keep], doc[keep]
        at = ((tokens >> np.uint64(31 if half else 32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        tokens, doc, at = tokens[order].astype(np.uint32), doc[order], at[order]
        tested = np.bincount(doc, minlength=len(sizes))
        head = np.array([r[:4] for r in self.rows], np.int64).T.tolist() + [tested.tolist()]
        cuts = np.searchsorted(at, np.arange(ranges + 1))
        owners = np.array([r[4] for r in self.rows], np.int64).tobytes()
        for r in range(ranges):
            part = slice(cuts[r], cuts[r + 1])
            counts = np.bincount(doc[part], minlength=len(sizes)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r]), pa.array([number]), pa.array([tokens[part].tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary()), pa.array([owners], pa.binary()),
                 pa.array([np.array(head, np.int64).tobytes() if r == 0 else None], pa.binary())],
                names=["range", "chunk", "tokens", "counts", "owners", "head"],
            )


PACKED = "range long, chunk long, tokens binary, counts binary, owners binary, head binary"


def shared_in_range(table: pa.Table) -> pa.Table:
    """For each chunk, how many of each document's tokens of this range another owner has as well."""
    counts = [np.frombuffer(b, np.uint32) for b in table.column("counts").to_pylist()]
    owners = np.concatenate([np.repeat(np.frombuffer(o, np.int64), c) for o, c in zip(table.column("owners").to_pylist(), counts)])
    tokens = np.concatenate([np.frombuffer(b, np.uint32) for b in table.column("tokens").to_pylist()])
    flags = np.zeros(len(tokens), bool)
    if len(tokens):
        order = np.argsort(tokens, kind="stable")
        ordered, held = tokens[order], owners[order]
        begin = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        several = np.minimum.reduceat(held, begin) != np.maximum.reduceat(held, begin)
        flags[order] = np.repeat(several, np.diff(np.append(begin, len(ordered))))
    total = np.append(0, np.cumsum(flags))
    out, at = [], 0
    for c in counts:
        ends = at + np.cumsum(c.astype(np.int64))
        out.append((total[ends] - total[ends - c]).astype(np.uint32).tobytes())
        at = int(ends[-1]) if len(c) else at
    return pa.table({"chunk": table.column("chunk"), "shared": pa.array(out, pa.binary()), "head": table.column("head")})


def decided(table: pa.Table, percent: int) -> pa.Table:
    """The documents of a chunk, and whether enough of their tokens are shared."""
    shared = sum(np.frombuffer(b, np.uint32).astype(np.int64) for b in table.column("shared").to_pylist())
    head = next(b for b in table.column("head").to_pylist() if b is not None)
    doc_id, n, d1, d2, tested = np.frombuffer(head, np.int64).reshape(5, -1)
    own = n - (n * percent + 99) // 100
    return pa.table({"doc_id": doc_id, "n": n, "d1": d1, "d2": d2, "open": (n > 0) & (tested - shared <= own)})


def tested(packed: DataFrame, percent: int) -> DataFrame:
    counted = packed.groupBy("range").applyInArrow(shared_in_range, "chunk long, shared binary, head binary")
    return counted.groupBy("chunk").applyInArrow(lambda t: decided(t, percent), SET + ", open boolean")


def dealt_texts(docs: DataFrame, words: int, ranges: int) -> DataFrame:
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, chunk = TaskContext.get().partitionId() << 32, Chunk()
        for doc_id, tokens in sets_of(batches, words):
            d1, d2 = digest(tokens)
            chunk.add((doc_id, len(tokens), d1, d2), d1, tokens)
            if chunk.size > CHUNK_TOKENS:
                yield from chunk.batches(number, ranges, True)
                number, chunk = number + 1, Chunk()
        if chunk.rows:
            yield from chunk.batches(number, ranges, True)

    return docs.mapInArrow(deal, PACKED)


def dealt_sets(sets: DataFrame, ranges: int) -> DataFrame:
    """The same for sets (doc_id, n, d1, d2, tokens) that have an owner."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, chunk = TaskContext.get().partitionId() << 32, Chunk()
        for batch in batches:
            for r in batch.to_pylist():
                chunk.add((r["doc_id"], r["n"], r["d1"], r["d2"]), r["owner"], np.frombuffer(r["tokens"], np.uint64))
                if chunk.size > CHUNK_TOKENS:
                    yield from chunk.batches(number, ranges, False)
                    number, chunk = number + 1, Chunk()
        if chunk.rows:
            yield from chunk.batches(number, ranges, False)

    return sets.mapInArrow(deal, PACKED)


def id_filter(ids: DataFrame, column: str, bits: int = 1 << 22):
    """A test that all given ids pass and few others; a fixed number of bits, so many ids pass more others."""
    mask = F.lit(bits - 1).cast("long")
    slot = F.xxhash64(column).bitwiseAND(mask)
    words = ids.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(xxhash64({column}) & 63 as int))")).alias("b")).collect()
    table = np.zeros(bits // 64, np.int64)
    for r in words:
        table[r["w"]] = r["b"]
    text = F.split(F.lit(",".join(map(str, table.tolist()))), ",").cast("array<bigint>")
    return lambda c: F.getbit(F.get(text, F.shiftright(F.xxhash64(c).bitwiseAND(mask), 6).cast("int")), F.xxhash64(c).bitwiseAND(63).cast("int")) == 1


def tokens_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """The sets of the classes in ``wanted`` (rep, n, d1, d2)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for doc_id, tokens in sets_of(batches, words):
            rows.append((doc_id, len(tokens), *digest(tokens), tokens.tobytes(), sketches(tokens) if len(tokens) else []))
            size += len(tokens)
            if size > CHUNK_TOKENS:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.binary(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "n", "d1", "d2", "tokens", "sketches"])

    near = docs.filter(id_filter(wanted, "rep")(F.col("doc_id")))
    found = near.mapInArrow(find, SET + ", tokens binary, sketches array<long>")
    return found.join(wanted.select(F.col("rep").alias("doc_id"), "n", "d1", "d2"), ["doc_id", "n", "d1", "d2"], "left_semi").dropDuplicates(["doc_id", "n", "d1", "d2"])


def verified(pairs: DataFrame, percent: int) -> DataFrame:
    """a, b of the pairs (a, b, ta, tb) that are similar."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(batch.column("ta"), batch.column("tb"))]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.select("a", "b", "ta", "tb").mapInArrow(test, "a long, b long")


def sketch_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links of documents with the smallest document that shares a sketch."""
    rows = sets.select("doc_id", F.posexplode("sketches").alias("k", "s"))
    lowest = rows.groupBy("k", "s").agg(F.min("doc_id").alias("b"), F.count(F.lit(1)).alias("many")).filter("many > 1").drop("many")
    pairs = rows.join(lowest, ["k", "s"]).groupBy(F.col("doc_id").alias("a")).agg(F.min("b").alias("b")).filter("a <> b")
    mine = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("ta")), "a")
    return verified(mine.join(sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("tb")), "b"), percent)


def minhash_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links of documents with the smallest documents of their min-hashes, where those are in other groups."""

    def low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [minima(np.frombuffer(b.as_py(), np.uint64)) for b in batch.column("tokens")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("owner"), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "owner", "lows"])

    rows = sets.select("doc_id", "owner", "tokens").mapInArrow(low, "doc_id long, owner long, lows array<long>").select("doc_id", "owner", F.posexplode("lows").alias("k", "s"))
    lowest = rows.groupBy("k", "s").agg(F.min(F.struct("doc_id", "owner")).alias("_p")).select("k", "s", F.col("_p.doc_id").alias("b"), F.col("_p.owner").alias("_other"))
    pairs = rows.join(lowest, ["k", "s"]).filter("owner <> _other").select(F.col("doc_id").alias("a"), "b").distinct()
    mine = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("ta")), "a")
    return verified(mine.join(sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("tb")), "b"), percent)


def matrix_links(sets: DataFrame, percent: int, part: int) -> DataFrame:
    """Links between groups: sets (doc_id, n, tokens, owner: the group) that may have one."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, owner, size, piece, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "owner", "size", "part", "tokens"))):
                t = np.frombuffer(raw, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t)] + [pa.array(np.full(len(t), v)) for v in (doc, owner, size, piece, len(t))], names=["token", "doc_id", "owner", "size", "part", "n"]
                )

    # Two similar sets are of one size class or of neighbouring ones.
    sized = sets.withColumn("size", F.floor(F.log("n") / F.lit(float(np.log(100 / percent))) + F.lit(1e-9)).cast("long"))
    many = sized.groupBy("owner", "size").agg(F.ceil(F.count(F.lit(1)) / part).alias("_parts"))
    piece = F.pmod(F.xxhash64("doc_id"), F.col("_parts")).cast("long").alias("part")
    parted = stored(sized.join(many, ["owner", "size"]).select("doc_id", "n", "owner", "size", piece, "tokens"), "parts")
    cells = parted.mapInArrow(spread, "token long, doc_id long, owner long, size long, part long, n long")
    spreads = cells.select("token", "owner").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("_groups"))
    ranked = cells.join(spreads, "token").withColumn("_rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("_groups", "token")))
    # If a token is the first common one of two sets, both have no more common tokens than come from it on.
    # That is enough for a partner of at most ``reach`` tokens.
    left = F.col("n") - F.col("_rank") + 1
    reach = F.floor(((100 + percent) * left - percent * F.col("n")) / percent)
    rare = ranked.withColumn("reach", reach).filter((F.col("reach") * 100 >= F.col("n") * percent) & (F.col("_groups") > 1))
    rare = stored(rare.select("token", "doc_id", "n", "owner", "size", "part", "reach"), "rare")
    keys = ["owner", "size", "part"]
    matrix = rare.groupBy(F.col("token").alias("_token"), *keys).agg(F.max("reach").alias("_reach"), F.min("n").alias("_least"))
    # Of two groups the one of the larger number asks.
    asking = rare.select("token", "doc_id", "n", "reach", F.col("owner").alias("_own"), F.col("size").alias("_size"))
    possible = (F.col("owner") < F.col("_own")) & (F.abs(F.col("size") - F.col("_size")) <= 1) & (F.col("n") <= F.col("_reach")) & (F.col("_least") <= F.col("reach"))
    asked = asking.join(matrix, (F.col("token") == F.col("_token")) & possible).select("doc_id", *keys).distinct()
    queries = asked.join(parted.select("doc_id", F.col("tokens").alias("_raw")), "doc_id").select(F.col("doc_id").alias("query"), F.col("_raw").alias("asking"), *(F.col(k).alias(f"in_{k}") for k in keys))

    def open_part(members: pa.Table, queries: pa.Table) -> pa.Table:
        links = []
        if len(members) and len(queries):
            own = [np.frombuffer(b, np.uint64) for b in members.column("tokens").to_pylist()]
            ids = members.column("doc_id").to_pylist()
            union = np.unique(np.concatenate(own))
            for q, raw in zip(queries.column("query").to_pylist(), queries.column("asking").to_pylist()):
                t = np.frombuffer(raw, np.uint64)
                if len(np.intersect1d(t, union, assume_unique=True)) >= least_common(len(t), percent):
                    hit = next((k for k, o in enumerate(own) if similar(t, o, percent)), None)
                    if hit is not None:  # one link joins the query to the whole group
                        links.append((q, ids[hit]))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return parted.select("doc_id", "tokens", *keys).groupBy(*keys).cogroup(queries.groupBy(*(f"in_{k}" for k in keys))).applyInArrow(open_part, "a long, b long")


def grouped(sets: DataFrame, links: DataFrame) -> DataFrame:
    """Sets with their group as ``owner``: the smallest document of the component."""
    roots = components(links).withColumnRenamed("node", "doc_id")
    rows = sets.select("doc_id", "n", "d1", "d2", "tokens").join(roots, "doc_id", "left")
    return stored(rows.withColumn("owner", F.coalesce("root", "doc_id")).drop("root"), "grouped")


def asking_others(groups: DataFrame, percent: int, ranges: int) -> DataFrame:
    """The sets of which enough tokens stand in other groups."""
    may = tested(dealt_sets(groups, ranges), percent).filter("open").select("doc_id")
    return stored(groups.join(may, "doc_id", "left_semi"), "asking")


def classes(docs: DataFrame, percent: int = 80, words: int = 5, part: int = 64) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = rows.filter(F.col("doc_id").isNotNull())
    ranges = max(8, -(-known.count() // 8192))
    every = stored(tested(dealt_texts(known, words, ranges), percent), "sets")
    reps = every.filter("open").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"))
    sets = stored(tokens_of(known, reps, words), "tokens")
    links = stored(sketch_links(sets, percent), "links")
    some = asking_others(grouped(sets, links), percent, ranges)
    links = stored(links.unionByName(minhash_links(some, percent)), "links")
    fewer = asking_others(grouped(some, links), percent, ranges)
    more = matrix_links(fewer, percent, part)
    linked = components(links.unionByName(more))
    named = reps.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("n", "d1", "d2", F.coalesce("root", "rep").alias("_root"))
    # Classes that may link with nothing are components of their own copies.
    copies = every.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("_first")).join(named, ["n", "d1", "d2"], "left")
    joined = every.join(copies, ["n", "d1", "d2"], "left")
    out = joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("_root", "_first", "doc_id").alias("component_id"))
    lost = rows.filter(F.col("doc_id").isNull())
    sized = lost.mapInArrow(lambda it: sizes(it, words), "doc_id long, n_shingles long").withColumn("component_id", F.lit(None).cast("long"))
    return out.unionByName(sized)


def sizes(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for doc_id, tokens in sets_of(batches, words):
        yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([len(tokens)])], names=["doc_id", "n_shingles"])
