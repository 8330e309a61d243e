"""Line deduplication across documents: frequent lines stay in one document only.

Lines are exploded with their positions and normalised to keys; the distinct documents of
each key's hash are counted, and a key found in ``least_documents`` or more loses its lines
everywhere but in the document of the largest id.  What is left is put together again by
position.

* A key is a 128-bit hash; the text of a line is never shuffled.  Documents travel once, to
  the positions that they lose.
* (key, document) rows are made distinct before the shuffle and counts are combined
  map-side; the join of lines with frequent keys is one that AQE splits where a key is hot.
* Text between dropped positions is taken as slices of the line array, so a document of many
  lines costs its length, not lines times drops.  Everything is DataFrame functions.

Defined cases: a null or empty text is one empty line; rows that share a doc_id are one
document, and each keeps its own row; a null doc_id is a document of its own (one for all
such rows) below all others; lines repeated in the document that keeps them all stay; an
empty table gives an empty result; a very long text is one array of lines in one task, and
nothing of it grows by more than its length; other columns are carried in ``deduplicated``
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import bind, kept

LEAST_CHARS = 40
LEAST_DOCUMENTS = 5
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, LOWER)


def _row() -> list[Column]:
    """``_id, _text, _a, _b``: equal rows have equal marks, whatever other columns hold."""
    text = F.coalesce("text", F.lit(""))
    return [F.col("doc_id").cast("bigint").alias("_id"), text.alias("_text"),
            F.xxhash64(text).alias("_a"), F.xxhash64(F.lit(1), text).alias("_b")]


def _marks(docs: DataFrame, least_chars: int) -> DataFrame:
    """``_id, _a, _b, pos, k1, k2`` of every line long enough."""
    lines = docs.select(*_row()).select("_id", "_a", "_b", F.posexplode(F.split("_text", "\n", -1)).alias("pos", "line"))
    # the stripped line is never longer, so short lines leave before they are normalised
    lines = lines.filter(F.char_length("line") >= least_chars)
    lines = bind(lines, "key", line_key(F.col("line"))).filter(F.char_length("key") >= least_chars)
    return lines.select("_id", "_a", "_b", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2"))


def dropped_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """``_id, _a, _b, drops``: ascending positions that each row loses, for rows that lose any."""
    marks = kept(_marks(docs, least_chars), "line-keys")
    holders = marks.select("k1", "k2", "_id").distinct()
    frequent = holders.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("documents"), F.max("_id").alias("keeper"))
    # stored, so that both sides of the join are plain shuffles, which AQE can split at a hot key
    frequent = kept(frequent.filter(F.col("documents") >= least_documents).drop("documents"), "frequent-lines")
    lost = marks.join(frequent, ["k1", "k2"]).filter(F.col("_id").isNull() | (F.col("_id") < F.col("keeper")))
    return lost.groupBy("_id", "_a", "_b").agg(F.sort_array(F.collect_set("pos")).alias("drops"))


def _between(lines: str, edges: str) -> Column:
    """The elements between the edges (positions left out, with -1 and the number of lines), as slices."""
    lines, edges = F.col(lines), F.col(edges)
    return F.flatten(F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda i: F.slice(
        lines, F.get(edges, i - 1) + 2, F.get(edges, i) - F.get(edges, i - 1) - 1)))


def _rejoined(docs: DataFrame, out: list[Column | str], **limits: int) -> DataFrame:
    """``out`` of each row, with ``_lines`` all lines, ``_drops`` and ``_left`` at hand."""
    drops = dropped_lines(docs, **limits).select(
        F.col("_id").alias("_did"), F.col("_a").alias("_da"), F.col("_b").alias("_db"), "drops")
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *_row())
    joined = held.join(drops, held["_id"].eqNullSafe(drops["_did"]) & (held["_a"] == drops["_da"]) & (held["_b"] == drops["_db"]), "left")
    joined = joined.select("_row", "_id", "_text", F.coalesce("drops", F.array().cast("array<int>")).alias("_drops"))
    whole = joined.filter(F.size("_drops") == 0).select(
        "_row", "_id", (F.size(F.split("_text", "\n", -1))).alias("_n"), F.lit(0).alias("_lost"), F.col("_text").alias("_left"))
    cut = bind(joined.filter(F.size("_drops") > 0), "_lines", F.split("_text", "\n", -1))
    cut = bind(cut, "_edges", F.concat(F.array(F.lit(-1)), "_drops", F.array(F.size("_lines"))))
    cut = cut.select("_row", "_id", F.size("_lines").alias("_n"), F.size("_drops").alias("_lost"),
                     F.array_join(_between("_lines", "_edges"), "\n").alias("_left"))
    return whole.unionByName(cut).select(*out)


def deduplicated(docs: DataFrame, **limits: int) -> DataFrame:
    """The documents with their remaining text; a text that loses nothing is as it was."""
    columns = [F.col("_row").getField(c).alias(c) for c in docs.columns if c != "text"]
    text = F.when(F.col("_lost") == 0, F.col("_row").getField("text")).otherwise(F.col("_left")).alias("text")
    at = docs.columns.index("text")
    return _rejoined(docs, [*columns[:at], text, *columns[at:]], **limits)


def digests(docs: DataFrame, **limits: int) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of every document."""
    return _rejoined(docs, [F.col("_id").alias("doc_id"), F.col("_n").cast("bigint").alias("n_lines"),
                            F.col("_lost").cast("bigint").alias("n_dropped"),
                            F.sha2(F.col("_left").cast("binary"), 256).alias("kept_sha256")], **limits)
