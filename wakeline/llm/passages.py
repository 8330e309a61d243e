"""Removal of passages that repeat across documents, by a suffix structure.

A byte goes if a window of ``SPAN`` bytes that covers it also starts earlier: in a document
of smaller id, or further ahead in the same one.

* **Pieces.** The minimal k-mer among those of a window (its anchor) depends on the window
  alone, so equal windows have equal anchors.  Neighbouring windows mostly share one, and
  their union is a piece of at most 176 bytes.  Windows of different anchors cannot be equal,
  which cuts the collection into independent small ones without losing a window.
* **Equal pieces** are settled by hash; only the first copy of each goes on.  Copies inside
  one Arrow batch are settled before the shuffle, so a passage that a third of all documents
  share is sent once a batch.
* **Different pieces of one anchor** are fetched from the texts and put through the
  column-wise construction of ``column_bwt`` in blocks of whole anchors: rounds are bounded
  by the piece length, and neighbours that share ``SPAN`` bytes are equal windows.  Equal windows
  agree on so much around their anchor that one of a few hashes about it must be equal too;
  pieces without an equal one in their block have no window to find and are left out before.
* **Hot anchors.** Around a common passage the pieces of one anchor are as many as its
  documents.  A first pass finds anchors with many different pieces in a task; their pieces
  are cut into single windows, which have their own hash as key.  There are at most
  ``MOST_HOT`` such anchors at any size, because their counts sum up to no more than all.

The external files of the construction are Spark's: pieces are dealt to blocks by a shuffle
and read in order once; the lists of a block are bounded and stay in memory.

Defined cases: a null text is empty; a text shorter than ``SPAN`` loses nothing; rows with
one id are taken in the order of their texts, and rows equal in both are one document; null
ids come first; an empty table gives an empty result; other columns are carried where
documents are returned and ignored elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakeline.llm.column_bwt import column_wise
from wakeline.llm.common import kept, running_start, sealed, unsealed
from wakeline.llm.encoding import flat, runs
from wakeline.session import ship

SPAN = 100
KMER = 24
REACH = SPAN - KMER + 1
#: Texts are worked on in stretches of about so many bytes, long ones with overlap.
STRETCH = 1 << 20
#: An anchor with so many different pieces in one task is counted for the hot list.
HOT_IN_TASK = 64
HOT_PIECES = 2048
MOST_HOT = 100_000
#: Most bytes before the anchor of a window, by class; a window reaches SPAN bytes with those behind.
BEFORE = (9, 19, 29, 39, 49, 59, 69, SPAN - KMER)
#: Bytes of the pieces that are put through one construction.
BLOCK_BYTES = 400_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


#: A fixed random number for each byte.
_BYTE = _mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _BASE)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_BASE, STRETCH + 4 * SPAN)
_DOWN = _powers(np.uint64(pow(int(_BASE), -1, 1 << 64)), STRETCH + 4 * SPAN)


def _kmers(x: np.ndarray) -> np.ndarray:
    """Hash of each k-mer of the bytes (as random numbers ``x``)."""
    n, h = len(x), x
    for step in (1, 2, 4, 8):  # k-mers of 2, 4, 8 and 16 bytes
        h, eight = h[:-step] * _UP[step] + h[step:], h
    return _mix(h[:n - KMER + 1] * _UP[KMER - 16] + eight[16:16 + n - KMER + 1])


def _placed(h: np.ndarray) -> np.ndarray:
    """Numbers of which the least is the anchor's: hash in the high half, place in the low, so that ties go to the first."""
    return (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)


def pieces(data: np.ndarray, bounds: np.ndarray, hot: np.ndarray) -> dict[str, np.ndarray]:
    """Pieces of the texts in ``data``, which begin at ``bounds[:-1]``.

    ``key`` of the anchor (or the window, for the anchors in ``hot``), ``hash`` of the piece,
    ``text`` number, ``start`` in ``data`` and number of ``windows``.
    """
    none = {k: np.zeros(0, np.int64) for k in ("key", "hash", "text", "start", "windows")}
    n = len(data)
    if n < SPAN:
        return none
    x = _BYTE[data]
    h = _kmers(x)
    v = _placed(h)
    for step in (1, 2, 4, 8, 16, 32):
        v = np.minimum(v[:-step], v[step:])
    v = np.minimum(v[: n - SPAN + 1], v[REACH - 64: REACH - 64 + n - SPAN + 1])
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: n - SPAN + 1]
    at = np.flatnonzero(np.arange(n - SPAN + 1) + SPAN <= bounds[text + 1])
    if len(at) == 0:
        return none
    anchor = (v[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.ones(len(at), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(first)
    count = np.diff(np.append(begin, len(at)))
    key = h[anchor[begin]].view(np.int64)
    is_hot = np.isin(key, hot) if len(hot) else np.zeros(len(key), bool)
    start = at[begin]
    if is_hot.any():
        reps = np.where(is_hot, count, 1)
        start = np.repeat(start, reps) + (np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps))
        key, single = np.repeat(key, reps), np.repeat(is_hot, reps)
        count = np.where(single, 1, np.repeat(count, reps))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * _UP[:n])])
    body = _mix((sums[start + count + SPAN - 1] - sums[start]) * _DOWN[start] + count.astype(np.uint64)).view(np.int64)
    if is_hot.any():
        key = np.where(single, _mix(body.view(np.uint64)).view(np.int64), key)
    return {"key": key, "hash": body, "text": text[start], "start": start, "windows": count}


def _stretches(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """``data, bounds, rows, offset``: runs of short texts, or parts of a long one."""
    for a, b in runs(texts, STRETCH):
        data, bounds = flat(texts.slice(a, b - a))
        if len(data) <= STRETCH:
            yield data, bounds, np.arange(a, b), 0
        else:
            for offset in range(0, len(data) - SPAN + 1, STRETCH):
                part = data[offset: offset + STRETCH + SPAN - 1]
                yield part, np.asarray([0, len(part)]), np.asarray([a]), offset


def _batch_pieces(batch: pa.RecordBatch, hot: np.ndarray) -> dict[str, np.ndarray]:
    """All pieces of a batch with document id and start in the document."""
    found = []
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
    for data, bounds, rows, offset in _stretches(batch.column("text")):
        p = pieces(data, bounds, hot)
        p["start"] = p["start"] - bounds[p["text"]] + offset
        p["doc"] = ids[rows[p.pop("text")]]
        found.append(p)
    return {k: np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64)
            for k in ("key", "hash", "doc", "start", "windows")}


def _settled(p: dict[str, np.ndarray]) -> tuple[dict, dict]:
    """The first copy of each piece, and the copies."""
    order = np.lexsort((p["start"], p["doc"], p["hash"], p["key"]))
    p = {k: v[order] for k, v in p.items()}
    copy = np.zeros(len(order), bool)
    copy[1:] = (p["key"][1:] == p["key"][:-1]) & (p["hash"][1:] == p["hash"][:-1])
    lead = np.maximum.accumulate(np.where(copy, 0, np.arange(len(order)))) if len(order) else np.zeros(0, np.int64)
    self_same = copy & (p["doc"] == p["doc"][lead]) & (p["start"] == p["start"][lead])
    return {k: v[~copy] for k, v in p.items()}, {k: v[copy & ~self_same] for k, v in p.items()}


def _joined(doc: np.ndarray, start: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring windows of a document as one stretch."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], (start + windows)[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (start[1:] > stop[:-1])
    begin = np.flatnonzero(first)
    return doc[begin], start[begin], (np.maximum.reduceat(stop, begin) if len(begin) else stop) - start[begin]


_PIECE = "kind int, key bigint, hash bigint, doc bigint, start bigint, windows bigint"


def _rows(kind: int, key, body, doc, start, windows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(doc), kind, np.int32)), *(pa.array(np.asarray(c, np.int64)) for c in (key, body, doc, start, windows))],
        ["kind", "key", "hash", "doc", "start", "windows"])


def _copies(doc, start, windows) -> pa.RecordBatch:
    doc, start, windows = _joined(doc, start, windows)
    # settled rows only pass the next shuffle; their ids spread them
    return _rows(1, _mix(doc.astype(np.int64).view(np.uint64)).view(np.int64), start, doc, start, windows)


def _hot_anchors(least: int):
    """Anchors with ``least`` different pieces in a task, and last the number of all pieces."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, total = [], 0
        nothing = np.zeros(0, np.int64)
        for batch in batches:
            first, _ = _settled(_batch_pieces(batch, nothing))
            keys.append(first["key"])
            total += len(first["key"])
        key, n = np.unique(np.concatenate([nothing, *keys]), return_counts=True)
        key, n = key[n >= least], n[n >= least]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(key, 0)), pa.array(np.append(n, 0)), pa.array(np.append(np.zeros(len(key), np.int64), total))],
            ["key", "n", "total"])
    return count


def _first_settling(hot: np.ndarray):
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, copies = _settled(_batch_pieces(batch, hot))
            yield _rows(0, *(first[k] for k in ("key", "hash", "doc", "start", "windows")))
            yield _copies(copies["doc"], copies["start"], copies["windows"])
    return settle


def _second_settling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of key: settle equal pieces; pieces that share an anchor go on."""
    names = ("key", "hash", "doc", "start", "windows")
    held = {k: np.zeros(0, np.int64) for k in names}

    def settle(p: dict) -> Iterator[pa.RecordBatch]:
        first, copies = _settled(p)
        key = first["key"]
        same = np.zeros(len(key) + 1, bool)
        same[1:-1] = key[1:] == key[:-1]
        more = same[1:] | same[:-1]
        if more.any():
            yield _rows(0, *(first[k][more] for k in names))
        if len(copies["doc"]):
            yield _copies(copies["doc"], copies["start"], copies["windows"])

    for batch in batches:
        table = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("kind", *names)}
        done = table["kind"] == 1
        if done.any():
            yield _rows(1, *(table[k][done] for k in names))
        held = {k: np.concatenate([held[k], table[k][~done]]) for k in names}
        if len(held["key"]):
            # the last anchor may go on in the next batch
            end = int(np.searchsorted(held["key"], held["key"][-1], "left"))
            yield from settle({k: v[:end] for k, v in held.items()})
            held = {k: v[end:] for k, v in held.items()}
    yield from settle(held)


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted pieces of each text."""
    for batch in batches:
        for r in np.flatnonzero(batch.column("_wanted").is_valid().to_numpy(zero_copy_only=False)).tolist():
            text = batch.column("text")[r].as_buffer()
            wanted = batch.column("_wanted")[r].values
            key, start, windows = (wanted.field(k).to_numpy(zero_copy_only=False) for k in ("key", "start", "windows"))
            doc = batch.column("doc_id")[r].as_py()
            for first in range(0, len(key), 50_000):  # bounded Arrow arrays
                k = slice(first, first + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[k]), pa.array(np.full(len(key[k]), doc, np.int64)), pa.array(start[k]),
                     pa.array([bytes(text[s: s + w + SPAN - 1]) for s, w in zip(start[k].tolist(), windows[k].tolist(), strict=True)], pa.binary())],
                    ["key", "doc", "start", "bytes"])


def _meeting(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which pieces may share a window with another of the block.

    A window with l bytes before its anchor has SPAN - KMER - l behind it.  So two equal ones agree
    on the least l of their class before the anchor, and on what its greatest l leaves behind.
    The anchor of a piece is its least k-mer, since it is that of every window.
    """
    x = _BYTE[data]
    ends = np.empty(2 * len(bounds) - 2, np.int64)
    ends[::2], ends[1::2] = bounds[:-1], bounds[1:] - KMER + 1
    # a last k-mer is added, so that the last end is a place
    least = np.minimum.reduceat(np.append(_placed(_kmers(x)), np.uint64(0xFFFFFFFFFFFFFFFF)), ends)[::2]
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    up, down = (_UP, _DOWN) if len(data) < len(_UP) else (
        _powers(_BASE, len(data) + 1), _powers(np.uint64(pow(int(_BASE), -1, 1 << 64)), len(data) + 1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * up[:len(x)])])
    met = np.zeros(len(anchor), bool)
    least_before = 0
    for most_before in BEFORE:
        begin, end = anchor - least_before, anchor + SPAN - most_before
        there = np.flatnonzero((begin >= bounds[:-1]) & (end <= bounds[1:]))
        around = _mix((sums[end[there]] - sums[begin[there]]) * down[begin[there]])
        _, which, n = np.unique(around, return_inverse=True, return_counts=True)
        met[there[n[which] > 1]] = True
        least_before = most_before + 1
    return met


def _block_copies(doc: np.ndarray, start: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    """Windows of a block's pieces that start earlier elsewhere in the block."""
    _, at, shares = column_wise(data, bounds[:-1], bounds[1:], SPAN)
    piece = np.searchsorted(bounds, at, "right") - 1
    piece[piece == len(bounds) - 1] -= 1
    group = np.cumsum(~shares)
    member = shares.copy()
    member[:-1] |= shares[1:]
    at, piece, group = at[member], piece[member], group[member]
    d, s = doc[piece], start[piece] + at - bounds[piece]
    order = np.lexsort((s, d, group))
    d, s, group = d[order], s[order], group[order]
    later = np.zeros(len(d), bool)
    later[1:] = group[1:] == group[:-1]
    lead = np.maximum.accumulate(np.where(later, 0, np.arange(len(d)))) if len(d) else np.zeros(0, np.int64)
    later &= (d != d[lead]) | (s != s[lead])
    doc, start, windows = _joined(d[later], s[later], np.ones(int(later.sum()), np.int64))
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start), pa.array(windows)], ["doc", "start", "windows"])


def _constructed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of key: whole anchors are gathered to blocks and constructed."""
    held: list[pa.RecordBatch] = []
    rows_in_block = BLOCK_BYTES // (SPAN + REACH // 2)

    def build(table: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if len(table):
            table = table.filter(pa.array(_meeting(*flat(table.column("bytes")))))
        if len(table):
            data, bounds = flat(table.column("bytes"))
            yield _block_copies(table.column("doc").to_numpy(), table.column("start").to_numpy(), data, bounds)

    def gathered() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        for first in range(0, len(batch), rows_in_block):
            held.append(batch.slice(first, rows_in_block))
            if sum(map(len, held)) >= rows_in_block:
                table = gathered()
                key = table.column("key").to_numpy()
                end = int(np.searchsorted(key, key[-1], "left"))
                yield from build(table.slice(0, end))
                held = [table.slice(end)]
    if held:
        yield from build(gathered())


def unique_ids(docs: DataFrame) -> DataFrame:
    """``docs`` with ``doc_id`` replaced by ``_order`` where ids are null or repeat.

    Returns rows ``doc_id, text, given`` and the other columns, in which doc_id is unique up to equal rows.
    """
    text = F.coalesce("text", F.lit("")).alias("text")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text, F.col("doc_id").alias("given"), *others)
    counted = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if counted.filter("doc_id IS NULL OR n > 1").limit(1).count() == 0:
        return rows
    distinct = rows.groupBy("doc_id", "text").agg(F.lit(1).cast("bigint").alias("one"))
    numbered = running_start(
        distinct.withColumns({"all": F.lit(0), "cut": F.coalesce(F.floor(F.col("doc_id") / 4096), F.lit(-(1 << 62)).cast("bigint"))}),
        ["all"], "cut", [F.col("doc_id").asc_nulls_first(), "text"], "one", "number")
    return kept(rows.join(numbered.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), "number"),
                          F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text") == F.col("_text")))
                .select(F.col("number").alias("doc_id"), "text", "given", *others), "numbered")


def repeated_windows(docs: DataFrame, hot_in_task: int = HOT_IN_TASK, hot_pieces: int = HOT_PIECES) -> DataFrame:
    """``doc_id, spans``: stretches of window starts that also start earlier.

    ``docs`` has unique ids (up to equal rows) and texts without nulls.  The two limits
    decide which anchors are cut into windows, not what is found.
    """
    ship(docs.sparkSession)
    texts = docs.select("doc_id", "text")
    counts = kept(texts.mapInArrow(_hot_anchors(hot_in_task), "key bigint, n bigint, total bigint").groupBy("key").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total")), "anchors")
    total = counts.agg(F.sum("total")).first()[0] or 0
    least = max(hot_pieces, total // MOST_HOT)
    hot = np.asarray([r.key for r in counts.filter(F.col("n") >= least).select("key").collect()], np.int64)
    ordered = texts.mapInArrow(_first_settling(hot), _PIECE).repartition("key").sortWithinPartitions("key")
    settled = kept(ordered.mapInArrow(_second_settling, _PIECE), "pieces", cleanup=True)
    wanted = settled.filter("kind = 0").groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("key", "start", "windows")).alias("_wanted"))
    # a left join of all columns, as the one with the spans is, so that Spark shuffles the texts once for both
    fetched = docs.join(wanted, F.col("doc_id") == F.col("_doc"), "left").mapInArrow(
        _fetched, "key bigint, doc bigint, start bigint, bytes binary")
    built = fetched.repartition("key").sortWithinPartitions("key").mapInArrow(_constructed, "doc bigint, start bigint, windows bigint")
    copies = settled.filter("kind = 1").select("doc", "start", "windows").unionByName(built)
    return copies.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("start", "windows")).alias("spans"))


def _covered(spans: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """Removed runs of a text: begins and ends."""
    start = spans.field("start").to_numpy(zero_copy_only=False)
    stop = start + spans.field("windows").to_numpy(zero_copy_only=False) + SPAN - 1
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    first = np.ones(len(start), bool)
    first[1:] = start[1:] > stop[:-1]
    begin = np.flatnonzero(first)
    return start[begin], stop[np.append(begin[1:] - 1, len(start) - 1)]


def _left(batches: Iterator[pa.RecordBatch], emit) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, spans = batch.column("text"), batch.column("spans")
        results = []
        for r in range(len(batch)):
            text = texts[r].as_buffer().to_pybytes() if texts[r].is_valid else b""
            if spans[r].is_valid and len(spans[r]):
                begin, end = _covered(spans[r].values)
                keep = [text[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(text)], strict=True)]
                results.append((len(text), len(text) - sum(map(len, keep)), len(begin), keep))
            else:
                results.append((len(text), 0, 0, [text]))
        yield emit(batch, results)


def _digest(batch: pa.RecordBatch, results: list) -> pa.RecordBatch:
    n, removed, spans, keep = zip(*results, strict=True) if results else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [batch.column("given"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
         pa.array([hashlib.sha256(b"".join(k)).hexdigest() for k in keep], pa.string())],
        ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def digests(docs: DataFrame, **limits: int) -> DataFrame:
    """What is left of every document: sizes and hash of the remaining bytes."""
    rows = unique_ids(docs.select("doc_id", "text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.join(repeated_windows(rows, **limits), "doc_id", "left").mapInArrow(
        lambda batches: _left(batches, _digest), f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents without repeated passages, cut at characters.

    A character of which a byte is removed goes as a whole.  Documents of which nothing is
    left are dropped.
    """
    rows = unique_ids(sealed(docs).withColumn("_none", F.col("text").isNull()))
    names = rows.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(batch: pa.RecordBatch, results: list) -> pa.RecordBatch:
            texts = ["".join(part.decode("utf-8", "ignore") for part in k) if removed else None for _, removed, _, k in results]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], [*names, "left"])
        yield from _left(batches, emit)

    out = rows.join(repeated_windows(rows), "doc_id", "left").mapInArrow(cut, T.StructType([*rows.schema.fields, T.StructField("left", T.StringType())]))
    touched = F.col("left").isNotNull()
    return unsealed(out.filter(~touched | (F.length("left") > 0)).withColumns({
        "doc_id": F.col("given"),
        "n_chars": F.when(touched, F.length("left").cast("bigint")).otherwise(F.col("n_chars")),
        "text": F.when(touched, F.col("left")).when(~F.col("_none"), F.col("text")),
    }), docs.columns)
