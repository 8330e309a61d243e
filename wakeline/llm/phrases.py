"""Phrase collocations by best-first branch-and-bound growth over prefixes.

A phrase of two or three words scores ``10^6 * a^2 / (l * r)`` at its worst cut, where a, l
and r count the phrase and the two parts.  Each language's best surviving phrases are found
without counting all triples:

* Words are counted, then pairs of frequent words: no phrase is more frequent than its parts.
* A pair is the prefix of triples.  A triple of prefix p cannot be more frequent than p, and
  its part after the first word is at least as frequent as itself, so at its first cut it
  scores at most ``10^6 * f(p) / f(first word)``: the prefix's bound, which also bounds the
  pair's own score.
* Best first: a round sets a mark for each open language and expands the prefixes whose bound
  reaches it, and counts to both sides of the pairs whose score reaches it, so that it is known
  whether a frequent triple holds them.  Everything that scores at the mark or above is then
  settled, ties included.  A language with enough survivors is done; for the others the mark
  falls to four times as many pairs, at last to zero.

Words are numbered by a 64-bit hash seeded by language; a hash of two words fails the job
(another ``seed`` mends it), so counts are exact.  Tasks count in numpy, a million phrases
at a time, so a phrase that is everywhere costs a row a task and block.  The words and prefixes
of interest go to the tasks as a bit table of at most 8 MB whatever their number; what it lets
through besides is counted exactly too and does no harm but work, which beyond some 60 million
keys grows to that of counting everything.

Defined cases: a null text is empty; a null language is ``und``; rows that share an id are
texts of their own; pieces never cross texts; a very long text is read in stretches, its word
numbers (17 bytes each) are in memory at once; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wakeline.llm.common import kept
from wakeline.llm.encoding import _LOWER, flat, runs
from wakeline.llm.near_duplicates import _BASE, _BYTE, _DOWN, _UP, STRETCH, _mix, _powers
from wakeline.session import ship

LIMIT = 2_000
LEAST_COUNT = 10
INSIDE_PERCENT = 50
#: Pairs above the first mark, as a multiple of the limit, and how many times as many the next.
FIRST, MORE = 2, 4
#: Phrases that a task holds before it merges equal ones, and distinct ones that it then keeps.
PENDING, KEEP = 1_000_000, 500_000
#: Words that a task remembers to have spelt.
SPELT = 1_500_000
BITS = 26
OUT_ROWS = 1 << 17

_SPACE, _BREAK = (np.zeros(256, bool) for _ in range(2))
_SPACE[[32, 9]] = True
_BREAK[[10, 11, 12, 13, *b".,;:!?"]] = True
_GAP = _SPACE | _BREAK


def _stretch(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hash, first byte, end and piece number of each word, and the number of pieces ended."""
    n = len(data)
    solid = ~_GAP[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = (_UP, _DOWN) if n < len(_UP) else (_powers(_BASE, n + 1), _powers(pow(int(_BASE), -1, 1 << 64), n + 1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[_LOWER[data]] * up[:n])])
    words = _mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    breaks = np.flatnonzero(_BREAK[data])
    return words, begin, end, np.searchsorted(breaks, begin), len(breaks)


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hash, first byte, end and piece number of each word of all texts in a row.

    A text beyond ``STRETCH`` (which is alone then) is read in stretches cut between words.
    """
    if len(data) <= STRETCH or len(bounds) > 2:
        return _stretch(data, bounds)[:4] if len(data) else tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    parts, at, ended = [], 0, 0
    while at < len(data):
        end = min(len(data), at + STRETCH)
        if end < len(data):
            gap = np.flatnonzero(_GAP[data[at:end]])
            if len(gap):
                end = at + int(gap[-1]) + 1
            else:
                step = next((k for k in range(end, len(data), STRETCH) if _GAP[data[k: k + STRETCH]].any()), len(data))
                end = step + int(np.argmax(_GAP[data[step: step + STRETCH]])) if step < len(data) else len(data)
        words, begin, stop, piece, breaks = _stretch(data[at:end], np.asarray([0, end - at]))
        parts.append((words, begin + at, stop + at, piece + ended))
        at, ended = end, ended + breaks
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _numbered(batch: pa.RecordBatch, seed: int) -> Iterator[tuple]:
    """For runs of texts: word numbers, whether each goes on in the piece of the one before,
    the bytes, where words begin and end, and the row of each word."""
    texts = batch.column("text")
    langs = batch.column("lang").dictionary_encode()
    seeds, _ = _seeds(langs.dictionary, seed)
    code = langs.indices.to_numpy(zero_copy_only=False)
    for a, b in runs(texts, STRETCH):
        data, bounds = flat(texts.slice(a, b - a))
        words, begin, end, piece = _words(data, bounds)
        row = np.searchsorted(bounds, begin, "right") - 1
        ids = _mix(words * _BASE + seeds[code[a:b]][row]) if len(row) else words
        joined = np.zeros(len(ids), bool)
        joined[1:] = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
        yield ids, joined, data, begin, end, row + a


def _seeds(langs: pa.Array, seed: int) -> tuple[np.ndarray, list[str]]:
    names = langs.to_pylist()
    hashes = [0] * len(names)
    for i, name in enumerate(names):
        h = seed
        for byte in name.encode():
            h = (h * int(_BASE) + byte + 1) & 0xFFFFFFFFFFFFFFFF
        hashes[i] = h
    return _mix(np.asarray(hashes, np.uint64)), names


def merged(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows added up."""
    if len(counts) == 0:
        return columns, counts
    key = columns[0]
    for c in columns[1:]:
        key = _mix(key * _BASE + c)
    order = np.argsort(key, kind="stable")
    del key
    for i in range(len(columns)):  # in place of the unordered ones, so that they go
        columns[i] = columns[i][order]
    counts = counts[order]
    new = np.ones(len(counts), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.add.reduceat(counts, first)


class _Tally:
    """Counts of rows of word numbers, handed on when too many are distinct."""

    def __init__(self, names: list[str]):
        self.names, self.parts, self.size = names, [], 0

    def add(self, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        self.parts.append((columns, np.ones(len(columns[0]), np.int64)))
        self.size += len(columns[0])
        if self.size >= PENDING:
            columns, counts = self._merge()
            if len(counts) >= KEEP:
                yield from self._out(columns, counts)
            else:
                self.parts, self.size = [(columns, counts)], len(counts)

    def rest(self) -> Iterator[pa.RecordBatch]:
        yield from self._out(*self._merge())

    def _merge(self) -> tuple[list[np.ndarray], np.ndarray]:
        held, self.parts, self.size = self.parts, [], 0
        if not held:
            return [np.zeros(0, np.uint64) for _ in self.names], np.zeros(0, np.int64)
        # a part's column goes as soon as it is copied
        columns = [np.concatenate([p[0].pop(0) for p in held]) for _ in self.names]
        counts = np.concatenate([p[1] for p in held])
        del held
        return merged(columns, counts)

    def _out(self, columns: list[np.ndarray], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(counts), OUT_ROWS):
            cut = slice(at, at + OUT_ROWS)
            yield pa.RecordBatch.from_arrays([*(pa.array(c[cut].view(np.int64)) for c in columns), pa.array(counts[cut])], [*self.names, "a"])


def _word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """``id, lang, word, a`` of every word of every language."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "lang", "word", "a"]
        tally, known = _Tally(["id"]), np.zeros(0, np.uint64)

        def counted(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in found:
                nothing = pa.nulls(len(b), pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0), nothing, nothing, b.column(1)], names)

        for batch in batches:
            lang = batch.column("lang")
            for ids, _, data, begin, end, row in _numbered(batch, seed):
                distinct, at = np.unique(ids, return_index=True)
                # a word is spelt once a task, or again after very many others
                at = at[~np.isin(distinct, known)]
                if len(at):
                    known = ids[at] if len(known) > SPELT else np.concatenate([known, ids[at]])
                    lower = _LOWER[data].tobytes()
                    spelt = pa.array([lower[s:e] for s, e in zip(begin[at].tolist(), end[at].tolist(), strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at].view(np.int64)), lang.take(pa.array(row[at])),
                                                      spelt.cast(pa.string()), pa.array(np.zeros(len(at), np.int64))], names)
                yield from counted(tally.add([ids]))
        yield from counted(tally.rest())

    rows = docs.mapInArrow(task, "id bigint, lang string, word string, a bigint")
    words = kept(rows.groupBy("id").agg(F.sum("a").alias("a"), F.max("lang").alias("lang"), F.max("word").alias("word"),
                                        ((F.min("lang") != F.max("lang")) | (F.min("word") != F.max("word"))).alias("two")), "words")
    if words.filter("two").limit(1).count():
        raise RuntimeError(f"two words have one number; call with a seed other than {seed}")
    return words.drop("two")


def bit_table(keys: DataFrame) -> np.ndarray:
    """Bits of the column ``key`` (a hash), as 64-bit words; at most ``2 ** (BITS - 6)`` reach the driver."""
    at = F.shiftrightunsigned("key", 64 - BITS)
    rows = keys.select(F.shiftright(at, 6).alias("word"), F.expr("shiftleft(1L, cast(key >> 32 & 63 as int))").alias("bit"))
    found = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (BITS - 6), np.uint64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return table


def _listed(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    bit = np.uint64(1) << ((key >> np.uint64(32)) & np.uint64(63))
    return (table[key >> np.uint64(70 - BITS)] & bit) != 0


def _pair_key(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return _mix(one * _BASE + two)


def _hashed(pairs: DataFrame) -> DataFrame:
    """``key`` of each pair, as :func:`_pair_key` gives it in the tasks."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two = (b.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("w1", "w2"))
            yield pa.RecordBatch.from_arrays([pa.array(_pair_key(one, two).view(np.int64))], ["key"])
    return pairs.select("w1", "w2").mapInArrow(task, "key bigint")


def _phrase_counts(docs: DataFrame, seed: int, names: list[str], chosen: Callable, least: int, purpose: str) -> DataFrame:
    """Counts of the phrases at the places that ``chosen(ids, joined)`` gives, if ``least`` or more."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, k = _Tally(names), len(names)
        for batch in batches:
            for ids, joined, *_ in _numbered(batch, seed):
                at = chosen(ids, joined)
                if len(at):
                    yield from tally.add([ids[at + i] for i in range(k)])
        yield from tally.rest()

    rows = docs.mapInArrow(task, ", ".join(f"{n} bigint" for n in names) + ", a bigint")
    return kept(rows.groupBy(*names).agg(F.sum("a").alias("a")).filter(F.col("a") >= least), purpose)


def _pairs(spark: SparkSession, docs: DataFrame, frequent: DataFrame, least: int, seed: int) -> DataFrame:
    listed = spark.sparkContext.broadcast(bit_table(frequent.select(F.col("id").alias("key"))))

    def chosen(ids: np.ndarray, joined: np.ndarray) -> np.ndarray:
        good = _listed(listed.value, ids)
        return np.flatnonzero(joined[1:] & good[1:] & good[:-1])

    return _phrase_counts(docs, seed, ["w1", "w2"], chosen, least, "pairs")


def _triples(spark: SparkSession, docs: DataFrame, expanded: DataFrame, settled: DataFrame, least: int, seed: int) -> DataFrame:
    """Triples that begin with an expanded pair, or end with one whose fate must be settled."""
    prefixes = spark.sparkContext.broadcast(bit_table(_hashed(expanded)))
    suffixes = spark.sparkContext.broadcast(bit_table(_hashed(settled)))

    def chosen(ids: np.ndarray, joined: np.ndarray) -> np.ndarray:
        if len(ids) < 3:
            return np.zeros(0, np.int64)
        key = _pair_key(ids[:-1], ids[1:])
        wanted = _listed(prefixes.value, key[:-1]) | _listed(suffixes.value, key[1:])
        return np.flatnonzero(joined[1:-1] & joined[2:] & wanted)

    return _phrase_counts(docs, seed, ["w1", "w2", "w3"], chosen, least, "triples")


def _score(a: str, left: str, right: str):
    """floor(10^6 * a^2 / (l * r)) in decimals: exact for counts below 10^16."""
    wide = lambda c: f"cast({c} as decimal(19,0))"
    return F.expr(f"(cast({wide(a)} * {wide(a)} as decimal(32,0)) * 1000000) div cast({wide(left)} * {wide(right)} as decimal(38,0))")


def _scored_triples(triples: DataFrame, words: DataFrame, pairs: DataFrame) -> DataFrame:
    """``lang, w1, w2, w3, a, l, r, score`` at the worst cut, the first of equal ones."""
    count = words.select("id", F.col("a").alias("f"))
    pair = pairs.select("w1", "w2", F.col("a").alias("f2"))
    rows = triples.join(words.select(F.col("id").alias("w1"), F.col("a").alias("l1"), "lang"), "w1")
    rows = rows.join(count.withColumnsRenamed({"id": "w3", "f": "r2"}), "w3")
    rows = rows.join(pair.withColumnRenamed("f2", "l2"), ["w1", "w2"])
    rows = rows.join(pair.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f2").alias("r1")), ["w2", "w3"])
    rows = rows.withColumn("s1", _score("a", "l1", "r1")).withColumn("s2", _score("a", "l2", "r2"))
    first = F.col("s1") <= F.col("s2")
    return rows.select("lang", "w1", "w2", "w3", "a", F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"),
                       F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))


def _marks(pairs: DataFrame, langs: DataFrame, place: int) -> DataFrame:
    """``lang, mark``: the score at that place of each language, 0 where there are fewer pairs."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"))
    nth = pairs.join(langs, "lang", "left_semi").withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= place)
    nth = nth.groupBy("lang").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("c"))
    return langs.join(nth, "lang", "left").select("lang", F.when(F.col("c") >= place, F.col("least")).otherwise(F.lit(0)).alias("mark"))


def _survivors(pairs: DataFrame, triples: DataFrame, marks: DataFrame, inside: int) -> DataFrame:
    """Candidates that reach their language's mark and lie in no triple of ``inside`` percent."""
    held = triples.select("w1", "w2", "a").unionByName(triples.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    held = held.groupBy("w1", "w2").agg(F.max("a").alias("most"))
    free = pairs.join(held, ["w1", "w2"], "left").filter(F.col("most").isNull() | (100 * F.col("most") < inside * F.col("a")))
    free = free.select("lang", "w1", "w2", F.lit(None).cast("bigint").alias("w3"), "a", "l", "r", "score")
    return free.unionByName(triples).join(marks, "lang").filter(F.col("score") >= F.col("mark")).drop("mark")


def collocations(docs: DataFrame, limit: int = LIMIT, least: int = LEAST_COUNT, inside: int = INSIDE_PERCENT,
                 first: int = FIRST, seed: int = 1) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases of two or three words."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    every = _word_counts(texts, seed)
    sizes = every.groupBy("lang").agg(F.sum("a").alias("n"))
    words = kept(every.filter(F.col("a") >= least), "frequent")
    counted = _pairs(spark, texts, words, least, seed)
    pairs = counted.join(words.select(F.col("id").alias("w1"), F.col("a").alias("l"), "lang"), "w1").join(
        words.select(F.col("id").alias("w2"), F.col("a").alias("r")), "w2")
    bound = F.expr("(cast(a as decimal(19,0)) * 1000000) div cast(l as decimal(19,0))")
    pairs = kept(pairs.select("lang", "w1", "w2", "a", "l", "r", _score("a", "l", "r").alias("score"), bound.alias("bound")), "scored-pairs")
    frontier, candidates = pairs, pairs.drop("bound")

    open_ = kept(candidates.select("lang").distinct(), "open")
    marks = settled = triples = None
    place = first * limit
    while open_.limit(1).count():
        mark = kept(_marks(candidates, open_, place), "mark")
        now = frontier.join(mark, "lang")
        if marks is not None:  # what lies above the mark before was expanded then
            now = now.join(marks.withColumnRenamed("mark", "before"), "lang").filter(
                "bound < before OR score < before").withColumn("again", F.col("bound") >= F.col("before"))
        else:
            now = now.withColumn("again", F.lit(False))
        found = _triples(spark, texts, now.filter("bound >= mark AND NOT again"), now.filter("score >= mark"), least, seed)
        triples = found if triples is None else kept(triples.unionByName(found).distinct(), "triples")
        scored = kept(_scored_triples(triples, words, counted), "scored-triples")
        enough = _survivors(candidates, scored, mark, inside).groupBy("lang").agg(F.count(F.lit(1)).alias("c"))
        judged = kept(mark.join(enough, "lang", "left").withColumn("done", (F.col("mark") <= 0) | (F.coalesce("c", F.lit(0)) >= limit)), "judged")
        done = judged.filter("done").select("lang", "mark")
        settled = done if settled is None else kept(settled.unionByName(done), "settled")
        open_, marks = judged.filter("NOT done").select("lang"), mark
        place *= MORE
    if settled is None:
        return spark.createDataFrame([], "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint")

    best = _survivors(candidates, scored, settled, inside)
    spelt = words.select("id", "word")
    for i in (1, 2, 3):
        best = best.join(spelt.withColumnsRenamed({"id": f"w{i}", "word": f"t{i}"}), f"w{i}", "left")
    best = best.withColumn("phrase", F.concat_ws(" ", "t1", "t2", "t3"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return top.join(sizes, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("bigint").alias("score"))
