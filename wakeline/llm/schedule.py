"""Mixing sources to target weights by a low-discrepancy schedule.

Slot ``i`` of the schedule has the golden-ratio point ``frac(i * phi)``; the source whose
stretch of the cumulative targets holds the point owns the slot.  A source's documents are
shuffled, laid end to end and cut into blocks of equal words; its k-th slot takes its k-th
block, starting over when all are used, until its target is reached.  So any stretch of the
schedule is close to the target mixture, whatever its length.

Targets: sources by code point (nulls last) weigh 5, 2, 1, repeating, and share 150 % of all
words; a target stops at twice its source's words, and the excess is shared again by weight.

Slots are ranked and documents placed by running sums over slices (``running_start``); no
task holds a source.  Points with a rank that the source no longer needs are skipped, and
the few ranks that the sequence leaves out are appended at its end.

Defined cases: a null text has no words; documents without words are taken 0 times; repeated
rows are documents of their own; an empty table gives an empty result; other columns are
carried where documents are returned and ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.common import SPACES, WORD, kept, ordered_key, running_start, sealed, unsealed, words

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BLOCK_WORDS = 2048
#: Points are multiples of this odd number modulo 2^32: the golden ratio in 32 bits.
GOLDEN, MODULUS = 2_654_435_769, 1 << 32
#: More slots would overflow the product; blocks grow instead.
MAX_SLOTS = 1 << 31
CELLS = 4096
SLOTS_PER_SLICE = 4096


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id``, source key, words and shuffle order of every row, kept as a table."""
    shuffled = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return kept(docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", ordered_key(F.col("source")).alias("queue"),
        F.size(words(F.coalesce("text", F.lit("")))).cast("bigint").alias("size"), shuffled.alias("deal"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
    ).withColumn("cut", F.substring("deal", 1, 3)), "sizes")


def targets(rows: DataFrame) -> DataFrame:
    """A row per source: its words, its target and its place in the cumulative targets.

    A cap binds for the sources of least cap/weight first.  Running sums in that order give
    the level at which the next source is still below its cap.
    """
    by_name = Window.orderBy("queue")
    by_ratio = Window.orderBy("ratio", "queue")
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    weight = F.get(F.array(*(F.lit(float(w)) for w in WEIGHTS)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))))
    s = rows.groupBy("queue").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    s = s.withColumns({"cap": MOST * F.col("source_size"), "ratio": MOST * F.col("source_size") / F.col("weight"),
                       "wanted": SHARE * F.sum("source_size").over(all_rows)})
    s = s.withColumns({"_caps": F.coalesce(F.sum("cap").over(upto), F.lit(0.0)),
                       "_weights": F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))})
    level = (F.col("wanted") - F.col("_caps")) / F.col("_weights")
    # the first source in this order that does not reach its cap sets the level for the rest
    first = F.min(F.when(level <= F.col("ratio"), F.struct(F.col("ratio"), F.col("queue"), level.alias("level")))).over(all_rows)
    s = s.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.coalesce(first["level"], F.lit(0.0))))
    return s.select("queue", "source_size", "target")


def _planned(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """Targets in whole words, blocks and slots of each source; block size; slots in all."""
    t = targets(rows)
    total = t.agg(F.sum("target")).first()[0] or 0.0
    block = max(BLOCK_WORDS, int(total // MAX_SLOTS) + 1)
    up = lambda a: F.ceil(a / F.lit(block)).cast("bigint")
    t = t.withColumns({"words": F.round("target").cast("bigint"), "blocks": up(F.col("source_size"))})
    t = t.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(0).cast("bigint"))
    t = t.withColumn("rest", F.col("words") - F.col("passes") * F.col("source_size"))
    t = t.withColumn("slots", F.col("passes") * F.col("blocks") + up(F.col("rest")))
    cum = Window.orderBy("queue").rowsBetween(Window.unboundedPreceding, 0)
    share = F.sum("slots").over(cum) / F.sum("slots").over(Window.partitionBy())
    t = t.withColumn("hi", F.when(F.sum("slots").over(Window.partitionBy()) > 0, F.floor(share * MODULUS)).otherwise(0).cast("bigint"))
    t = t.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("queue")), F.lit(0).cast("bigint")))
    t = kept(t, "targets")
    return t, block, int(t.agg(F.sum("slots")).first()[0] or 0)


def slots(plan: DataFrame, n: int, spark) -> DataFrame:
    """``queue, rank, slot``: the owner of every slot and how many slots it had before.

    ``slot`` is null for ranks that the sequence left out.
    """
    cell = MODULUS // CELLS
    owners = plan.filter("hi > lo").select("queue", "lo", "hi", "slots", F.explode(F.sequence(
        F.floor(F.col("lo") / cell), F.floor((F.col("hi") - 1) / cell))).alias("cell"))
    points = spark.range(n).select(F.col("id").alias("slot"), F.pmod((F.col("id") + 1) * F.lit(GOLDEN), F.lit(MODULUS)).alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") / cell))
    owned = points.join(owners, (points["cell"] == owners["cell"]) & (F.col("point") >= F.col("lo")) & (F.col("point") < F.col("hi")))
    width = max(SLOTS_PER_SLICE, n // 65_536)
    owned = owned.select("queue", "slot", "slots", F.floor(F.col("slot") / width).alias("cut"), F.lit(1).cast("bigint").alias("one"))
    ranked = running_start(owned, ["queue"], "cut", ["slot"], "one", "rank").filter(F.col("rank") < F.col("slots"))
    had = owned.groupBy("queue").agg(F.count(F.lit(1)).alias("had"))
    missing = plan.join(had, "queue", "left").filter(F.coalesce("had", F.lit(0)) < F.col("slots"))
    missing = missing.select("queue", F.explode(F.sequence(F.coalesce("had", F.lit(0)).cast("bigint"), F.col("slots") - 1)).alias("rank"))
    return ranked.select("queue", "rank", "slot").unionByName(missing.withColumn("slot", F.lit(None).cast("bigint")))


def taken(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pieces that the schedule takes, and the targets.

    Pieces: ``row, queue, slot, pass`` and words ``piece_from`` to ``piece_to`` of the document.
    """
    plan, block, n = _planned(rows)
    laid = running_start(rows.filter("size > 0"), ["queue"], "cut", ["deal", "size", "text_hash", "row"], "size", "start")
    laid = laid.withColumn("stop", F.col("start") + F.col("size"))
    parts = laid.select("row", "queue", "start", "stop", F.explode(F.sequence(
        F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block))).alias("block"))
    uses = slots(plan, n, rows.sparkSession).join(
        plan.select("queue", "source_size", "blocks", "passes", "rest"), "queue")
    turn = F.floor(F.col("rank") / F.col("blocks")).cast("bigint")
    uses = uses.select("queue", "slot", turn.alias("pass"), F.pmod("rank", "blocks").alias("block"),
                       F.when(turn == F.col("passes"), F.col("rest")).otherwise(F.col("source_size")).alias("upto"))
    both = parts.join(uses, ["queue", "block"])
    begin = F.greatest("start", F.col("block") * block)
    end = F.least("stop", (F.col("block") + 1) * block, "upto")
    return both.select("row", "queue", "slot", "pass", (begin - F.col("start")).alias("piece_from"),
                       (end - F.col("start")).alias("piece_to")).filter("piece_to > piece_from"), plan


def mix(docs: DataFrame) -> DataFrame:
    """Words of every document that the mix takes, with its source's size and target."""
    rows = sized(docs)
    pieces, plan = taken(rows)
    used = pieces.groupBy("row").agg(F.sum(F.col("piece_to") - F.col("piece_from")).alias("taken"))
    return rows.join(used, "row", "left").join(plan.select("queue", "source_size", "target"), "queue").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("bigint")).alias("taken"))


def _first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    length = F.aggregate(
        F.slice(F.split(text, f"(?<={WORD})(?={SPACES[:-1]})"), F.lit(1), n), F.lit(0), lambda a, s: a + F.length(s))
    return F.substring(text, F.lit(1), length)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mixed documents: a row for each time that a document, or its first words, is taken.

    A source's blocks are used in full passes; only the document at the end of the last pass
    may be cut.
    """
    rows = sized(docs)
    pieces, _ = taken(rows)
    uses = pieces.groupBy("row", "pass").agg(F.max("piece_to").alias("upto"))
    # row numbers of a second scan may differ, so documents are found again by their content
    per_mark = rows.join(uses, "row").groupBy(_mark(F.col("queue"), F.col("text_hash")).alias("mark"), "size", "upto").agg(
        F.count(F.lit(1)).alias("times"))
    marked = sealed(docs).withColumn("mark", _mark(ordered_key(F.col("source")), F.xxhash64(F.coalesce("text", F.lit("")))))
    # equal rows have one mark, whose uses are those of all of them
    one = marked.withColumn("_k", F.row_number().over(Window.partitionBy("mark").orderBy("n_chars"))).filter("_k = 1")
    out = one.join(per_mark, "mark").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    cut = F.col("upto") < F.col("size")
    text = F.when(cut, _first_words(F.col("text"), F.col("upto").cast("int"))).otherwise(F.col("text"))
    return unsealed(out.withColumn("text", text).withColumn(
        "n_chars", F.when(cut, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))), docs.columns)


def _mark(queue: Column, text_hash: Column) -> Column:
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), queue, text_hash)
