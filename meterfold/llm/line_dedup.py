"""Removal of lines that many documents share, as keep bitmaps instead of texts.

A line's key is the line without white space at its ends, A-Z lowered. A key of at least
``min_chars`` code points that occurs in at least ``min_docs`` documents stays only in the
document with the largest doc_id that holds it; all other documents lose all their lines
with that key.

Keys travel as 128-bit hashes with (doc_id, position). They are range-partitioned and sorted
by hash, then by document (falling) and position, so the first occurrence in each document is
seen as the rows stream by. A hash is split into ``blocks`` sub-keys by document, which keeps
a line that stands in a third of all documents out of a single task; the sub-keys' counts,
few for each hash, are added up, and the decision goes back to the sub-keys.

The result is a bitmap for each document that loses a line: 64 lines a word, 1 = dropped,
words after the last dropped line left out. DataFrame functions only.

Null and empty texts are one empty line, which is too short to be dropped. Repeated rows of a
doc_id are one document; they lose the same lines. A null doc_id is a document of its own,
smaller than all others. Columns other than doc_id and text are kept and never looked at.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterfold.llm.common import lower_ascii, stored

BLANKS = " \t\n\x0b\x0c\r"
HASH = ["_h1", "_h2"]


def lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n")


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """(hash, block-ready document, position) of every line that is long enough."""
    keys = F.transform(lines(lower_ascii(F.col("text"))), lambda s: F.btrim(s, F.lit(BLANKS)))
    rows = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_row"), F.posexplode(keys).alias("_pos", "_key"))
    return rows.filter(F.char_length("_key") >= min_chars).select(
        F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(7), "_key").alias("_h2"), "_doc", "_row", "_pos"
    )


def dropped_lines(found: DataFrame, min_docs: int, blocks: int) -> DataFrame:
    """(document, row, position) of the lines that go."""
    blocked = found.withColumn("_block", F.pmod(F.xxhash64("_doc"), F.lit(blocks)).cast("int"))
    group = [*HASH, "_block"]
    order = [F.desc_nulls_last("_doc"), F.col("_pos")]
    streamed = blocked.select(*group, "_doc", "_pos").repartitionByRange(*group).sortWithinPartitions(*group, *order)
    before = F.lag("_doc").over(Window.partitionBy(*group).orderBy(*order))
    at = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    first = streamed.withColumn("_before", before).withColumn("_at", at)
    first = first.withColumn("_first", (F.col("_at") == 1) | ~F.col("_doc").eqNullSafe(F.col("_before")))
    runs = first.filter("_first").groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.max("_doc").alias("_top"))
    keys = runs.groupBy(*HASH).agg(F.sum("_n").alias("_docs"), F.max("_top").alias("_keeper")).filter(F.col("_docs") >= min_docs)
    decided = runs.select(*group).join(keys.select(*HASH, "_keeper"), HASH)
    return blocked.join(decided, group).filter(~F.col("_doc").eqNullSafe(F.col("_keeper"))).select("_doc", "_row", "_pos")


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, blocks: int = 64) -> DataFrame:
    """doc_id, row_hash (of the text) and ``dropped``, an array of 64-bit words, for documents that lose lines."""
    found = stored(occurrences(docs, min_chars), "lines")
    gone = dropped_lines(found, min_docs, blocks)
    words = gone.groupBy("_doc", "_row", F.expr("cast(_pos div 64 as int)").alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, _pos % 64)")).alias("_bits"))
    by_doc = words.groupBy("_doc", "_row").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias("_map"), F.max("_word").alias("_last"))
    dense = F.transform(F.sequence(F.lit(0), F.col("_last")), lambda w: F.coalesce(F.element_at("_map", w), F.lit(0).cast("long")))
    return by_doc.select(F.col("_doc").alias("doc_id"), F.col("_row").alias("row_hash"), dense.alias("dropped"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``given`` (all columns of ``docs``), ``left`` (the text that is left), n_lines and n_dropped."""
    given = docs.select(F.struct(*docs.columns).alias("given"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"))
    marks = bitmaps.select(F.col("doc_id").alias("_doc"), F.col("row_hash").alias("_row"), F.col("dropped").alias("words"))
    joined = given.join(marks, F.col("id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_row")), "left")
    text, words, none = F.col("given.text"), F.col("words"), F.lit(0).cast("long")
    kept = F.filter(lines(text), lambda s, i: F.getbit(F.coalesce(F.get(words, F.shiftright(i, 6)), none), i % 64) == 0)
    return joined.select(
        "given",
        F.when(words.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("left"),
        F.size(lines(text)).cast("long").alias("n_lines"),
        F.coalesce(F.aggregate(words, none, lambda a, w: a + F.bit_count(w)), none).alias("n_dropped"),
    )


def dedup(docs: DataFrame, **options) -> DataFrame:
    """The documents with the text that is left; other columns are kept."""
    left = apply_bitmaps(docs, keep_bitmaps(docs, **options))
    return left.select(*((F.col("left") if c == "text" else F.col(f"given.`{c}`")).alias(c) for c in docs.columns))


def summary(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the text that is left."""
    left = apply_bitmaps(docs.select("doc_id", "text"), keep_bitmaps(docs, **options))
    return left.select(F.col("given.doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped", F.sha2("left", 256).alias("kept_sha256"))


SQL = """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM split),
k AS (SELECT doc_id, i, parts[i] AS line,
        translate(trim(parts[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key FROM l),
c AS (SELECT line_key, max(doc_id) AS keeper FROM k WHERE length(line_key) >= 20 GROUP BY line_key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.i, k.line, c.line_key IS NOT NULL AND k.doc_id <> c.keeper AS gone FROM k LEFT JOIN c ON k.line_key = c.line_key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
