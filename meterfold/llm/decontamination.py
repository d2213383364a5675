"""Benchmark passages in documents: SimHash of item-sized windows, then exact similarity.

Words are runs of letters and digits, lowered. An item is the bag of its shingles of ``words``
words (an item with fewer words is one shingle). A window of a document is as long as an item
and may start at every shingle; at the end of a document it is cut off where one of its
shingles would put the item beyond. How many shingles each window shares with the item, with
their numbers, changes only where an occurrence enters or leaves, so a running sum over the
hits gives it for all starts. Of the windows that share enough, the best one of a document for
an item is formed; the others cannot change the result.

Each window and each item has a 64-bit SimHash over its shingles, every occurrence weighing
one. Fingerprints are cut into four blocks; two that differ in at most ``radius`` bits differ
in at most radius / 4 bits in one block, so joining each block of the windows with all such
variations of the items' blocks finds every pair within the radius. Candidates are verified
exactly: the weighted Jaccard similarity of their bags (sum of the smaller counts by sum of the
larger) must reach ``similarity``. At a similarity of 0.8 two fingerprints are 10 bits apart on
average and beyond the default radius of 19 in about one case of a thousand.

Equal windows are one class, compared once, however many documents hold them. The items'
shingles are looked up inside each row if there are at most ``inline`` of them; beyond that,
hits come from a shuffled join, and the windows' shingles from a second one. DataFrame functions only.

Null and empty texts, and items without a word, match nothing. Repeated rows are reported once;
further columns are not read. Items are told apart by their shingles; one without an id is an item
like any other and is reported with a null item_id.
"""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterfold.llm.common import stored

BLOCKS, BLOCK_BITS = 4, 16


def words_of(text):
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def shingles_of(words, n: int):
    """Hashes of all runs of ``n`` words, in order."""
    starts = F.sequence(F.lit(0), F.size(words) - n)
    runs = F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(n))))
    return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<bigint>"))


def simhash(shingles):
    """64 bits: whether more shingles have the bit than not."""

    def bit(b):
        balance = F.aggregate(shingles, F.lit(0), lambda a, h: a + F.getbit(h, b) * 2 - 1)
        return F.when(balance > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")

    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), bit)
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))


def block_values(fingerprint):
    """Array of (block, value)."""
    mask = F.lit((1 << BLOCK_BITS) - 1).cast("long")
    return F.array(*(F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fingerprint, BLOCK_BITS * k).bitwiseAND(mask).cast("int").alias("value")) for k in range(BLOCKS)))


def variations(most: int) -> list[int]:
    """The masks of at most ``most`` bits of a block, by rule."""
    return [m for m in range(1 << BLOCK_BITS) if m.bit_count() <= most]


def weighted_jaccard(a, b):
    """Sum of the smaller counts by sum of the larger, over the values of both arrays."""

    def count(array, x):
        return F.size(F.filter(array, lambda y: y == x))

    common = F.aggregate(F.array_distinct(F.array_intersect(a, b)), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))
    return common / (F.size(a) + F.size(b) - common)


def items_of(benchmark: DataFrame, words: int) -> DataFrame:
    """item_id, its number of words, shingle length and shingles."""
    rows = benchmark.select("item_id", words_of(F.col("text")).alias("_w")).filter(F.size("_w") > 0)
    n = F.least(F.size("_w"), F.lit(words))
    by_length = reduce(lambda c, k: c.when(n == k, shingles_of(F.col("_w"), k)), range(2, words + 1), F.when(n == 1, shingles_of(F.col("_w"), 1)))
    return rows.select("item_id", F.size("_w").alias("_words"), n.alias("_n"), by_length.alias("_item"))


def bit_table(rows: DataFrame, hash_col):
    """A test that all hashes of ``rows`` pass, and of the others about one in some thousand.

    Two bits for each hash in a table of 64 bits a hash, as words of an array literal; the
    caller bounds the number of rows.
    """
    bits = max(1 << 16, 1 << (64 * max(1, rows.count()) - 1).bit_length())
    mask = F.lit(bits - 1).cast("long")

    def places(h):
        return [h.bitwiseAND(mask), F.shiftrightunsigned(h, 25).bitwiseAND(mask)]

    each = rows.select(F.explode(F.array(*places(hash_col))).alias("_bit"))
    filled = each.groupBy((F.col("_bit") / 64).cast("long").alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_bit % 64 as int))")).alias("_bits")).collect()
    words = ["0"] * (bits // 64)
    for r in filled:
        words[r["_word"]] = str(r["_bits"])
    table = F.split(F.lit(",".join(words)), ",").cast("array<bigint>")

    def passes(h):
        first, second = ((F.getbit(F.get(table, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1) for p in places(h))
        return first & second

    return passes


def windows(docs: DataFrame, items: DataFrame, n: int, inline: int, similarity: float) -> DataFrame:
    """doc_id, row_hash, first word, number of words and shingles of each document's best window for each item of shingle length n."""
    group = ["_d", "_r", "_i1", "_i2"]
    places = items.filter(F.col("_n") == n).select("_i1", "_i2", F.size("_item").alias("_len"), F.posexplode("_item").alias("_offset", "_h"))
    places = places.groupBy("_i1", "_i2", "_len", "_h").agg(F.collect_set("_offset").alias("_offsets"))
    texts = docs.select(F.col("doc_id").cast("long").alias("_d"), F.xxhash64("text").alias("_r"), "text")
    rows = texts.select("_d", "_r", words_of(F.col("text")).alias("_w")).select("_d", "_r", shingles_of(F.col("_w"), n).alias("_all"))
    if places.count() <= inline:
        known = bit_table(places, F.col("_h"))
        hits = F.filter(F.sequence(F.lit(0), F.size("_all")), lambda i: known(F.get("_all", i)))
        # Outer, and filtered afterwards: a filter on the arrays would be moved into them and work them out anew for each element.
        found = rows.withColumn("_hits", hits).select("_d", "_r", "_all", F.explode_outer("_hits").alias("_pos"))
        found = found.filter(F.col("_pos").isNotNull()).select("_d", "_r", F.size("_all").alias("_total"), "_pos", F.get("_all", F.col("_pos")).alias("_h"))
    else:
        found = rows.select("_d", "_r", F.size("_all").alias("_total"), F.posexplode_outer("_all").alias("_pos", "_h"))
    # All that follows is within one document and item, so rows are dealt out once.
    seen = found.join(places, "_h").repartition(*group).groupBy(*group, "_total", "_len", "_h")
    seen = seen.agg(F.sort_array(F.collect_set("_pos")).alias("_at"), F.first("_offsets").alias("_offsets"))
    last = F.greatest(F.col("_total") - F.col("_len"), F.lit(0))

    def event(at, step: int, aligned: bool):
        return F.struct(at.alias("_s"), F.lit(step).alias("_step"), F.lit(aligned).alias("_aligned"))

    # An occurrence counts in the windows that hold it, but not as many before it as the item has.
    begins = F.transform("_at", lambda p, j: event(F.greatest(p - F.col("_len") + 1, F.coalesce(F.get("_at", j - F.size("_offsets")) + 1, F.lit(0)), F.lit(0)), 1, False))
    ends = F.transform("_at", lambda p: event(p + 1, -1, False))
    cut_off = F.flatten(F.transform(F.filter("_at", lambda p: p > last), lambda p: F.transform("_offsets", lambda o: event(p - o, 0, True))))
    cut_off = F.filter(cut_off, lambda e: e["_s"] > last)
    events = seen.select(*group, "_total", "_len", F.inline(F.concat(begins, ends, cut_off)))
    events = events.groupBy(*group, "_total", "_len", "_s").agg(F.sum("_step").alias("_step"), F.max("_aligned").alias("_aligned"))
    common = F.sum("_step").over(Window.partitionBy(*group).orderBy("_s"))
    like = F.col("_common") / (F.least(F.col("_len"), F.col("_total") - F.col("_s")) + F.col("_len") - F.col("_common"))
    fits = events.withColumn("_common", common).withColumn("_like", like).filter((F.col("_s") <= last) | F.col("_aligned")).filter(F.col("_like") >= similarity)
    best = fits.groupBy(*group, "_len").agg(F.max(F.struct("_like", (-F.col("_s")).alias("_s"))).alias("_best"))
    best = best.select(F.col("_d").alias("doc_id"), F.col("_r").alias("row_hash"), (-F.col("_best._s")).alias("first_word"), "_len").distinct()
    again = best.join(texts, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("row_hash") == F.col("_r")))
    again = again.select("doc_id", "row_hash", "first_word", "_len", words_of(F.col("text")).alias("_w"))
    # The window's words only, so its shingles alone are hashed.
    own = F.slice("_w", F.col("first_word") + 1, F.col("_len") + n - 1)
    again = again.select("doc_id", "row_hash", "first_word", (F.col("_len") + n - 1).alias("_words"), own.alias("_own"))
    return again.select("doc_id", "row_hash", "first_word", "_words", shingles_of(F.col("_own"), n).alias("_window")).distinct()


def leaks(
    docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, words: int = 5, radius: int = 19, inline: int = 200_000,
) -> DataFrame:
    """doc_id, row_hash (of the text), item_id and the best window: similarity, first_word, n_words."""
    items = stored(items_of(benchmark, words).withColumns({"_fp": simhash(F.col("_item")), "_i1": F.xxhash64("_n", "_item"), "_i2": F.xxhash64(F.lit(9), "_item")}), "items")
    lengths = sorted(r[0] for r in items.select("_n").distinct().collect())  # at most ``words`` values
    found = [windows(docs, items, n, inline, similarity).withColumn("_n", F.lit(n)) for n in lengths]
    if not found:
        found = [windows(docs, items, words, inline, similarity).withColumn("_n", F.lit(words))]
    content = ["_c1", "_c2"]
    every = stored(reduce(DataFrame.unionByName, found).withColumns({"_c1": F.xxhash64("_n", "_window"), "_c2": F.xxhash64(F.lit(9), "_window")}), "windows")
    classes = every.groupBy(*content).agg(F.first("_window").alias("_window"), F.first("_n").alias("_n"))
    classes = classes.withColumn("_wfp", simhash(F.col("_window")))
    asked = classes.select(*content, "_window", "_n", "_wfp", F.inline(block_values(F.col("_wfp"))).alias("_block", "_value"))
    masks = F.array(*(F.lit(m) for m in variations(radius // BLOCKS)))
    # Items are known by their shingles: ids may be null, and ids of equal items only go with the result.
    item = ["_i1", "_i2"]
    kinds = items.dropDuplicates(item)
    offered = kinds.select(*item, F.col("_n").alias("_in"), "_fp", F.inline(block_values(F.col("_fp"))).alias("_block", "_v"))
    offered = offered.withColumn("_value", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("_v"))))).drop("_v")
    # Merged, not broadcast: shuffled bytes say little about how large the variations of many items are on the driver.
    near = asked.join(offered.select(*item, "_in", "_fp", "_block", "_value").hint("merge"), ["_block", "_value"])
    near = near.filter((F.col("_n") == F.col("_in")) & (F.bit_count(F.col("_fp").bitwiseXOR(F.col("_wfp"))) <= radius)).select(*content, *item).distinct()
    pairs = near.join(classes.select(*content, "_window"), content).join(kinds.select(*item, "_item"), item)
    same = pairs.withColumn("similarity", weighted_jaccard(F.col("_window"), F.col("_item"))).filter(F.col("similarity") >= similarity)
    same = same.select(*content, *item, "similarity").join(items.select(*item, "item_id").distinct(), item)
    hits = every.select("doc_id", "row_hash", "first_word", "_words", *content).join(same.select(*content, "item_id", "similarity"), content)
    best = F.max(F.struct("similarity", (-F.col("first_word")).alias("_at"), "_words")).alias("_best")
    return hits.groupBy("doc_id", "row_hash", "item_id").agg(best).select(
        "doc_id", "row_hash", "item_id", F.col("_best.similarity").alias("similarity"),
        (-F.col("_best._at")).cast("long").alias("first_word"), F.col("_best._words").cast("long").alias("n_words"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a benchmark passage."""
    bad = leaks(docs, benchmark, **options).select(F.col("doc_id").alias("_d"), F.col("row_hash").alias("_r")).distinct()
    given = docs.select(F.struct(*docs.columns).alias("given"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"))
    return given.join(bad, F.col("id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_r")), "left_anti").select("given.*")
