"""Quality rules with cross-document line frequency, in DataFrame functions only.

Every normalised line is hashed; for each host the documents that hold it are counted,
exact copies as one: a much copied document is not boilerplate, its copies go later.  A
line above the host's limit is boilerplate and removed, and a document that loses more than
half of its words is depleted and rejected, as is one that fails the base rules.

The limit is ``LINE_SHARE`` of the host's distinct documents, ten at least, so it means the same at
every size.  Lines are distinct within a document before the shuffle and counts are combined
map-side: a line that half of all documents share costs one row a task.

Defined cases: a null text is an empty one (no words, base rules fail); a null host is a
host of its own; a line without a word is no line; rows of one host and text count as one
document and each have its verdict; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import SPACES, WORD, bind, kept, ordered_key, sealed, unsealed, words

LINE_SHARE = 0.10
LEAST_LIMIT = 10
DEPLETED_BELOW = 0.5
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def row_key() -> Column:
    """What a row's verdict depends on; equal rows have equal verdicts."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"),
                      ordered_key(F.col("source")), F.coalesce("text", F.lit("")))


def normalised(line: Column) -> Column:
    """Lower case, digits as 0, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), SPACES, " "))


def _repeat_words(df: DataFrame) -> DataFrame:
    """``n_repeat_words``: words inside 5-word windows that occur twice or more."""
    df = bind(df, "_h", F.when(F.size("_w") < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(F.size("_w") - WINDOW, F.lit(0))),
                    lambda i: F.xxhash64(*(F.get(F.col("_w"), i + k) for k in range(WINDOW))))))
    df = bind(df, "_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(
        F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, j: F.coalesce(x["h"] == F.get(F.col("_s"), j)["h"], F.lit(False))
    df = bind(df, "_p", F.sort_array(F.filter(
        F.transform("_s", lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x["i"])), lambda p: p.isNotNull())))
    covered = F.aggregate(F.transform("_p", lambda p, i: F.least(F.lit(WINDOW), F.get(F.col("_p"), i + 1) - p)),
                          F.lit(0).cast("bigint"), lambda a, n: a + n)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint"))).drop("_h", "_s", "_p")


def measured(docs: DataFrame) -> DataFrame:
    """A row per document: base measures and its lines as (hash, words), without the text."""
    text = F.coalesce("text", F.lit(""))
    df = docs.select("doc_id", ordered_key(F.col("source")).alias("host"), row_key().alias("row_key"), F.xxhash64(text).alias("text_key"),
                     text.alias("text"))
    df = bind(df, "_w", words(F.col("text")))
    df = _repeat_words(df)
    df = bind(df, "_l", F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD)))
    long = lambda c: c.cast("bigint")
    return df.select(
        "doc_id", "host", "row_key", "text_key",
        long(F.size("_w")).alias("n_words"),
        long(F.length(F.translate("text", " \t\n\x0b\x0c\r", ""))).alias("word_chars"),
        long(F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
        long(F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
        "n_repeat_words",
        F.transform("_l", lambda line: F.struct(
            F.xxhash64(normalised(line)).alias("hash"), F.size(words(line)).alias("words"))).alias("lines"),
    ).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def common_lines(rows: DataFrame) -> DataFrame:
    """(host, hash) of the lines that more of the host's documents hold than its limit."""
    rows = rows.groupBy("host", "text_key").agg(F.any_value("lines").alias("lines"))
    hosts = rows.groupBy("host").agg(F.greatest(F.lit(float(LEAST_LIMIT)), F.count(F.lit(1)) * F.lit(LINE_SHARE)).alias("limit"))
    lines = rows.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["hash"]))).alias("hash"))
    counted = lines.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") > LEAST_LIMIT)
    return counted.join(hosts, "host").filter(F.col("docs") > F.col("limit")).select("host", "hash")


def verdicts(docs: DataFrame) -> DataFrame:
    """Measures and verdict of every document.

    ``n_removed_words`` counts the words of removed lines, ``removed`` lists their hashes.
    """
    rows = kept(measured(docs), "lines")
    lines = rows.select("host", "row_key", F.explode("lines").alias("x")).select("host", "row_key", "x.hash", "x.words")
    # one row a line and document, so equal rows do not add up
    lines = lines.join(common_lines(rows), ["host", "hash"])
    lost = lines.groupBy("row_key", "hash").agg(F.sum("words").alias("words"), F.count(F.lit(1)).alias("n"))
    lost = lost.groupBy("row_key").agg(F.sum("words").alias("_lost"), F.collect_list("hash").alias("removed"))
    copies = rows.groupBy("row_key").agg(F.count(F.lit(1)).alias("_n"))
    lost = lost.join(copies, "row_key")
    out = rows.drop("lines", "text_key").join(lost, "row_key", "left")
    removed = F.coalesce((F.col("_lost") / F.col("_n")).cast("bigint"), F.lit(0).cast("bigint"))
    out = out.withColumn("n_removed_words", removed).drop("_lost", "_n")
    depleted = F.col("n_words") - F.col("n_removed_words") < F.col("n_words") * DEPLETED_BELOW
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents that pass, without their boilerplate lines; others are dropped."""
    decisions = verdicts(docs).filter("kept").select("row_key", "removed").dropDuplicates(["row_key"])
    held = sealed(docs).withColumn("row_key", row_key()).join(decisions, "row_key")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda line: ~F.coalesce(
        line.rlike(WORD) & F.array_contains("removed", F.xxhash64(normalised(line))), F.lit(False))), "\n")
    changed = F.col("removed").isNotNull()
    return unsealed(held.withColumns({
        "n_chars": F.when(changed, F.length(left).cast("bigint")).otherwise(F.col("n_chars")),
        "text": F.when(changed, left).otherwise(F.col("text")),
    }), docs.columns)
