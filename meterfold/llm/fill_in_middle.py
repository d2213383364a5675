"""Fill-in-middle transformation: a document is cut twice and its middle moved to the end.

One ``fullmatch`` of a repeated group tiles the whole text with its units and keeps the end of
every repetition; their number and both cut offsets are read from that list, so no unit is
visited one by one. Where the cuts fall and which form is made follows from a hash of the
document's id, so a rerun gives the same rows.

Forms: ``psm`` is prefix, suffix, middle, each behind its mark; ``spm`` begins with the suffix;
``plain`` is the text as it is. A text stays plain if it is empty, holds a mark, or its draw says
so. Null texts count as empty, a null id is hashed as an empty one, repeated rows give repeated
results, an empty table gives an empty one. Other columns are not looked at.

The library keeps every repetition in memory and gives up after some millions of them. So a text of
more than ``WINDOW`` characters is matched window by window: the last unit of a window may go on, so
the next one begins with it. Units must not look further ahead than they reach.
"""

import hashlib
from array import array
from collections.abc import Iterator, Sequence

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterfold.llm.common import small_batches

#: Runs of letters, and every other character by itself.
UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
WINDOW = 1_000_000
OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def tiling(unit: str = UNIT) -> regex.Pattern:
    """Matches texts that are units from end to end; group 1 holds every unit. Atomic, so nothing is tried twice."""
    return regex.compile(f"(?:(?>({unit})))*+")


def unit_ends(text: str, tiles: regex.Pattern, window: int = WINDOW) -> Sequence[int]:
    """Where each unit of a text ends."""
    if len(text) <= window:
        return tiles.fullmatch(text).ends(1)
    ends, at, reach = array("q"), 0, window
    while at + reach < len(text):
        found = tiles.fullmatch(text, at, at + reach).ends(1)
        if len(found) == 1:  # one unit fills the window
            reach *= 2
            continue
        ends.extend(found[:-1])
        at, reach = found[-2], window
    ends.extend(tiles.fullmatch(text, at).ends(1))
    return ends


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers below 2**32 for a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def transformed(text: str, numbers: list[int], tiles: regex.Pattern, rate: int, spm: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    ends = unit_ends(text, tiles)
    n = len(ends)
    first, second, kept, order = numbers
    if not text or kept % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = sorted((first % (n + 1), second % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (a, b))
    prefix, middle, suffix = PREFIX + text[:a], MIDDLE + text[a:b], SUFFIX + text[b:]
    if order % 100 < spm:
        return n, "spm", a, b - a, suffix + prefix + middle
    return n, "psm", a, b - a, prefix + suffix + middle


def transform(docs: DataFrame, seed: int = 1, rate: int = 90, spm: int = 20) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (code points; null if plain) and the output text.

    ``rate`` is the share of documents to transform and ``spm`` that of the second form among
    them, both in per cent.
    """
    small_batches(docs.sparkSession)
    schema = OUT

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = tiling()
        names = [x.split()[0] for x in schema.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            for at in range(0, len(batch), 100):
                part = batch.slice(at, 100)
                ids = part.column("doc_id").cast(pa.int64()).to_pylist()
                texts = (x.as_py() or "" for x in part.column("text"))
                rows = [(i, *transformed(t, draws(i, seed), tiles, rate, spm)) for i, t in zip(ids, texts)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def restored(output: Column, form: Column) -> Column:
    """The text a transformed one was made from, by its marks alone; each occurs once in it."""
    p, s, m = (F.instr(output, mark) for mark in (PREFIX, SUFFIX, MIDDLE))

    def between(mark: str, start: Column, end: Column | None = None) -> Column:
        start = start + len(mark)
        size = (F.char_length(output) + 1 if end is None else end) - start
        return F.substring(output, start, size)

    middle = between(MIDDLE, m)
    psm = F.concat(between(PREFIX, p, s), middle, between(SUFFIX, s, m))
    spm = F.concat(between(PREFIX, p, m), middle, between(SUFFIX, s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


# The same rows in DuckDB's SQL, over the documents table.
SQL = """
WITH given AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
tiled AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS units,
    CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2,
    CAST('0x' || h[17:24] AS UBIGINT) AS h3, CAST('0x' || h[25:32] AS UBIGINT) AS h4
  FROM given),
cut AS (
  SELECT doc_id, t, units, CAST(len(units) AS BIGINT) AS n,
    CAST(least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS BIGINT) AS a,
    CAST(greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS BIGINT) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM tiled),
parts AS (
  SELECT doc_id, t, n, form,
    coalesce(array_to_string(units[1:a], ''), '') AS prefix,
    coalesce(array_to_string(units[a + 1:b], ''), '') AS middle,
    coalesce(array_to_string(units[b + 1:], ''), '') AS suffix
  FROM cut),
made AS (
  SELECT doc_id, n, form,
    CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
    CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output
  FROM parts),
marks AS (
  SELECT *, strpos(output, '<P>') AS p, strpos(output, '<S>') AS s, strpos(output, '<M>') AS m FROM made)
SELECT doc_id, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output
    WHEN 'psm' THEN substr(output, p + 3, s - p - 3) || substr(output, m + 3) || substr(output, s + 3, m - s - 3)
    ELSE substr(output, p + 3, m - p - 3) || substr(output, m + 3) || substr(output, s + 3, p - s - 3) END) AS restored_sha256
FROM marks
"""
