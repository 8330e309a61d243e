"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of units: its documents' token ids, cut into at most ``UNIT`` ids.
In each round a queue's deficit grows by its quantum, ``WINDOW`` times its target share, and
the queue sends units while the deficit covers them; what is left carries over to the next
round.  The whole stream of sent units is then cut at multiples of ``WINDOW``.

A queue that is never empty sends the unit whose ids end at place E of the queue in round
ceil((E - credit) / quantum), so rounds follow from running sums and no task has to replay
a queue: deficits carry across windows and partitions by arithmetic.  Each queue starts with
a credit drawn from its name, below its first unit, so that small queues do not all send in
one round.  Running sums go over slices (``running_start``); a queue may hold any share.

All windows are full but the last, so padding is less than one window.

Defined cases: a null text is empty and has the end id only; a null source is a queue of its
own; repeated rows are documents of their own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm import encoding
from wakeline.llm.common import kept, ordered_key, running_start
from wakeline.session import ship

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
WINDOW = 4096
UNIT = 1024
SLICES = 4096
ROUNDS_PER_SLICE = 16


def tokenized(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END_ID) -> DataFrame:
    """``row, doc_id, queue, cut, n, ids`` of every document, kept as a table.

    ``ids`` are two little-endian bytes each where the vocabulary allows, else four.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"),
                       ordered_key(F.col("source")).alias("queue"),
                       F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)).cast("int").alias("cut"), "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding.encoder(vocabulary, encoding.bytes_of, lower=True)
        kind = "<u2" if enc.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        for batch in batches:
            texts = batch.column("text")
            for a, b in encoding.runs(texts):
                found = encoding.ids(enc, texts.slice(a, b - a), end)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("row", "doc_id", "queue", "cut")),
                     pa.array([len(x) for x in found], pa.int64()),
                     pa.array([x.astype(kind).tobytes() for x in found], pa.binary())],
                    ["row", "doc_id", "queue", "cut", "n", "ids"])

    return kept(rows.mapInArrow(encode, "row bigint, doc_id bigint, queue string, cut int, n bigint, ids binary"), "token-ids")


def placed_units(rows: DataFrame, window: int = WINDOW, unit: int = UNIT) -> DataFrame:
    """``row, start, length, place``: every unit and its place in the sent stream.

    Targets are the queues' shares of all ids, so all queues last to the end.
    """
    queues = rows.groupBy("queue").agg(F.sum("n").alias("total"))
    ids = queues.agg(F.sum("total")).first()[0] or 0
    if ids == 0:
        ids = 1
    credit = F.pmod(F.xxhash64("queue"), F.lit(1 << 20)) / (1 << 20) * F.least(F.lit(unit), F.col("total"))
    queues = queues.select("queue", (F.lit(float(window)) * F.col("total") / F.lit(float(ids))).alias("quantum"), credit.alias("credit"))
    laid = running_start(rows.select("row", "doc_id", "queue", "cut", "n"), ["queue"], "cut", ["doc_id", "row"], "n", "begin")
    units = laid.select("row", "queue", "n", "begin", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / unit))).alias("k"))
    units = units.select("row", "queue", (F.col("k") * unit).alias("start"),
                         F.least(F.lit(unit), F.col("n") - F.col("k") * unit).alias("length"), "begin").join(queues, "queue")
    ends = F.col("begin") + F.col("start") + F.col("length")
    sent = units.select("row", "queue", "start", "length", (F.col("begin") + F.col("start")).alias("at"),
                        F.greatest(F.lit(1), F.ceil((ends - F.col("credit")) / F.col("quantum"))).cast("bigint").alias("round"))
    width = max(ROUNDS_PER_SLICE, ids // window // 65_536)
    # one running sum over all rounds: the whole stream is one group
    sent = sent.withColumns({"cut": F.floor(F.col("round") / width), "stream": F.lit(0)})
    return running_start(sent, ["stream"], "cut", ["round", "queue", "at"], "length", "place").select(
        "row", "start", "length", "place")


def pack(docs: DataFrame, window: int = WINDOW, unit: int = UNIT, vocabulary: str = VOCABULARY, end: int = END_ID) -> DataFrame:
    """A row for each piece of a document: where it is cut and where it stands."""
    rows = tokenized(docs, vocabulary, end)
    units = placed_units(rows, window, unit)
    first, last = F.floor(F.col("place") / window), F.floor((F.col("place") + F.col("length") - 1) / window)
    cuts = units.withColumn("sequence_id", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("place"), F.col("sequence_id") * window)
    stop = F.least(F.col("place") + F.col("length"), (F.col("sequence_id") + 1) * window)
    cuts = cuts.select("row", (F.col("start") + begin - F.col("place")).alias("start"), (stop - begin).alias("length"),
                       "sequence_id", (begin - F.col("sequence_id") * window).alias("offset"))
    cuts = cuts.groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("cuts"))
    return rows.select("row", "doc_id", "n", "ids").join(cuts, "row").mapInArrow(
        _checked, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with the checksum of their ids as unsigned 32-bit integers."""
    import numpy as np

    names = ["start", "length", "sequence_id", "offset"]
    for batch in batches:
        lists = batch.column("cuts")
        owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        flat = lists.flatten()
        piece = {name: flat.field(name) for name in names}
        start, length = (piece[k].to_numpy(zero_copy_only=False) for k in ("start", "length"))
        n = batch.column("n").to_numpy(zero_copy_only=False)
        held = batch.column("ids")
        sums, last, ids = np.zeros(len(owner), np.int64), -1, None
        for i, row in enumerate(owner.tolist()):
            if row != last:
                raw = held[row].as_buffer()
                ids, last = np.frombuffer(raw, "<u2" if len(raw) == 2 * n[row] else "<u4").astype("<u4"), row
            sums[i] = zlib.crc32(ids[start[i]: start[i] + length[i]])
        at = pa.array(owner)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(at), piece["start"], piece["length"], pa.array(sums), batch.column("n").take(at),
             piece["sequence_id"], piece["offset"]],
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
