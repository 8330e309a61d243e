"""MinHash near-duplicates with tensored banding, confirmed on full shingle sets.

Two small collections of ``GROUPS`` keys, each of ``ROWS`` minhashes, stand for
``GROUPS * GROUPS`` tables: the key of table (i, j) is the pair of the i-th key of the first
collection and the j-th of the second.  So 400 tables of eight minhashes cost 160 minhashes
a document instead of 3,200.  Two texts of likeness 0.85 miss every table with a chance
below 1e-6.

* Texts of equal shingle sets are one class before anything is compared.
* Half keys that only one class has cannot meet; a class enters only the tables whose two
  half keys it shares, so most classes enter none.
* No bucket is compared pair by pair.  Every member meets the bucket's most popular member
  (whose half keys most others share: the original among its copies), its centre; that is a
  row per document and centre.  The members of one centre, from whatever tables, are a group.
* Two members of a group are compared through its centre.  A member's residue is what it has
  and the centre lacks, or the other way round; the symmetric difference of two members is
  that of their residues.  At likeness t it is at most (1-t)/(1+t) of both sizes together, so
  two members whose residues are small enough are linked outright (the group's best member to
  all that it reaches), and all others must share residue shingles, so many that the rarest few
  of each residue must have one in common; what a member alone has, and what the centre alone has, are placed
  first and last without being looked up.  Only members of different components that share
  one of these are paired.  No candidate is dropped, and texts that lie just below the limit
  to each other for reasons of their own meet nowhere.
* Shingles that one class alone has bound its likeness to all others; members and pairs that
  the bound excludes are not compared.
* Pairs are confirmed on the full sets.  Components are merged by hooking each label to its
  least neighbour and following the hooks, in tables.

Defined cases: a null text or one without words has the empty set and no link; fewer than
five words are one shingle; rows that share a doc_id are one document with the links of
each text; a null doc_id has a null component and is kept; an empty table gives an empty result;
other columns are carried where documents are returned and ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.common import kept, sealed, unsealed
from wakeline.llm.encoding import _LOWER, _SPACE, flat, runs
from wakeline.session import ship

SHINGLE = 5
GROUPS = 20
ROWS = 4
#: Members of a group that are compared with those outside the centre's component before
#: residues are: the originals of further families among its members.
FURTHER_CENTRES = 4
STRETCH = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(31))


_BYTE = _mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _BASE)
_FACTORS = _mix(np.arange(1, 2 * GROUPS * ROWS + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, STRETCH + 1), _powers(_INVERSE, STRETCH + 1)


def _word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the first word of each text (and the end)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    solid = ~_SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = (_UP, _DOWN) if n < len(_UP) else (_powers(_BASE, n + 1), _powers(_INVERSE, n + 1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[_LOWER[data]] * up[:n])])
    words = _mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    return words, np.searchsorted(begin, bounds)


def _long_text(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A long text's word hashes, stretch by stretch between white space."""
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + STRETCH)
        if end < len(data):
            space = np.flatnonzero(_SPACE[data[at:end]])
            if len(space):
                end = at + int(space[-1]) + 1
            else:
                more = np.flatnonzero(_SPACE[data[end:]])
                end = end + int(more[0]) if len(more) else len(data)
        parts.append(_word_hashes(data[at:end], np.asarray([0, end - at]))[0])
        at = end
    words = np.concatenate(parts)
    return words, np.asarray([0, len(words)])


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct shingle hashes of each text in turn, and where each set begins."""
    data, bounds = flat(texts)
    words, at = _long_text(data) if len(texts) == 1 and len(data) > STRETCH else _word_hashes(data, bounds)
    count = np.diff(at)
    full = np.maximum(count - SHINGLE + 1, 0)
    text = np.repeat(np.arange(len(count)), full)
    begin = np.repeat(at[:-1] - (np.cumsum(full) - full), full) + np.arange(full.sum())
    value = np.zeros(len(begin), np.uint64)
    for k in range(SHINGLE):
        value = value * _BASE + words[begin + k] if len(begin) else value
    value = _mix(value)
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):
        whole = []
        for t in short.tolist():
            v = np.uint64(count[t])
            for w in words[at[t]: at[t + 1]]:
                v = np.uint64((int(v) * int(_BASE) + int(w)) & 0xFFFFFFFFFFFFFFFF)
            whole.append(v)
        text, value = np.concatenate([text, short]), np.concatenate([value, _mix(np.asarray(whole, np.uint64))])
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    distinct = np.ones(len(value), bool)
    distinct[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return value[distinct], np.searchsorted(text[distinct], np.arange(len(count) + 1))


def _half_keys(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The keys of both collections, a row per non-empty set."""
    keys = np.zeros((len(begin), 2 * GROUPS), np.uint64)
    for g in range(2 * GROUPS):
        key = np.full(len(begin), g + 1, np.uint64)
        for r in range(ROWS):
            key = _mix(key * _BASE + np.minimum.reduceat(values * _FACTORS[g * ROWS + r], begin))
        keys[:, g] = key
    return keys


def _set_marks(values: np.ndarray, at: np.ndarray) -> list[pa.Array]:
    """Two hashes and the size of each set: equal for equal sets."""
    n = np.diff(at)
    one, two = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        one[some] = np.add.reduceat(_mix(values), at[:-1][some])
        two[some] = np.add.reduceat(_mix(values ^ _BASE), at[:-1][some])
    return [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(n.astype(np.int64))]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for a, b in runs(texts, STRETCH):
            values, at = shingle_sets(texts.slice(a, b - a))
            n = np.diff(at)
            some = np.flatnonzero(n)
            halves = _half_keys(values, at[:-1][some]) if len(some) else np.zeros((0, 2 * GROUPS), np.uint64)
            sizes = np.where(n > 0, 2 * GROUPS, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)),
                                             pa.array(halves.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *_set_marks(values, at), lists],
                                             ["doc_id", "set1", "set2", "n", "halves"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of each text, with the marks of its class."""
    for batch in batches:
        texts = batch.column("text")
        for a, b in runs(texts, STRETCH):
            values, at = shingle_sets(texts.slice(a, b - a))
            marks = _set_marks(values, at)
            held = [values[at[i]: at[i + 1]].tobytes() for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([*marks, pa.array(held, pa.binary())], ["set1", "set2", "n", "shingles"])


def _each_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, held in enumerate(batch.column("shingles")):
            values = np.frombuffer(held.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(values), batch.column("node")[i].as_py(), np.int64)), pa.array(values)], ["node", "shingle"])


def _lone(sets: DataFrame) -> DataFrame:
    """``node, lone, own``: how many shingles of a class no other class has, and which."""
    once = sets.mapInArrow(_each_shingle, "node bigint, shingle bigint").groupBy("shingle").agg(
        F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).filter("c = 1")
    return kept(once.groupBy("node").agg(F.count(F.lit(1)).alias("lone"), F.collect_list("shingle").alias("own")), "lone")


def _shareable(buckets: DataFrame, lone: DataFrame, threshold: int) -> DataFrame:
    """Buckets with ``shared``, without members that cannot be like any other of the bucket.

    A shingle that one class alone has is in no intersection.  With ``shared`` others, a text
    of n shingles is like one of m at most if threshold * (n + m) <= (100 + threshold) * shared,
    so m must not be too large; the least size in the bucket tells whether any is small enough.
    """
    rows = buckets.join(lone.select("node", "lone"), "node", "left").withColumn("shared", F.col("n") - F.coalesce("lone", F.lit(0))).drop("lone")
    least = rows.groupBy("key").agg(F.min("n").alias("least"))
    rows = rows.join(least, "key").filter(threshold * (F.col("n") + F.col("least")) <= (100 + threshold) * F.col("shared"))
    rows = kept(rows.drop("least"), "buckets")
    met = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return kept(rows.join(met.select("key"), "key"), "buckets")


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Each row's batch and number, and both its sets as one ascending array with repeats."""
    for batch in batches:
        for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"), strict=True)):
            both = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)])
            both.sort(kind="stable")
            yield batch, i, both


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a, b, both``: how many shingles the two sets share."""
    for batch in batches:
        n = np.fromiter((np.count_nonzero(both[1:] == both[:-1]) for _, _, both in _both([batch])), np.int64, len(batch))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(n)], ["a", "b", "both"])


def _residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a, b, shingle, place`` for each shingle that only one of the two sets has and another member's residue may share.

    What ``a`` alone has (``own_a``) is in no other residue and comes first, unlisted.  What the centre
    alone has (``own_b``) is in every residue and comes last: its place is known, and it is listed only
    as far as the prefix reaches.  The others are ranked later; their place is what comes before them.
    """
    for batch, i, both in _both(batches):
        same = both[1:] == both[:-1]
        alone = np.ones(len(both), bool)
        alone[1:] &= ~same
        alone[:-1] &= ~same
        left = both[alone].view(np.int64)
        own_a, own_b = (np.asarray(batch.column(c)[i].as_py() or [], np.int64) for c in ("own_a", "own_b"))
        last = np.sort(own_b)
        middle = left[~np.isin(left, own_a) & ~np.isin(left, own_b)]
        before = len(left) - len(last)
        last = last[:max(batch.column("prefix")[i].as_py() - before, 0)]
        found = np.concatenate([middle, last])
        if len(found):
            place = np.concatenate([np.full(len(middle), before), before + 1 + np.arange(len(last))])
            late = np.repeat([False, True], [len(middle), len(last)])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), batch.column(c)[i].as_py(), np.int64)) for c in ("a", "b")]
                                             + [pa.array(found), pa.array(place), pa.array(late)], ["a", "b", "shingle", "place", "late"])


def _buckets(classes: DataFrame) -> DataFrame:
    """``key, node, popularity, n`` of tables that at least two classes enter."""
    halves = classes.select("node", "n", F.posexplode("halves").alias("place", "half"))
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    active = halves.join(shared, "half").groupBy("node", "n").agg(
        F.sum("classes").alias("popularity"),
        F.collect_list(F.when(F.col("place") < GROUPS, F.col("half"))).alias("left"),
        F.collect_list(F.when(F.col("place") >= GROUPS, F.col("half"))).alias("right"))
    entered = active.select("node", "n", "popularity", "right", F.explode("left").alias("l")).select(
        "node", "n", "popularity", "l", F.explode("right").alias("r")).select(
        F.xxhash64("l", "r").alias("key"), "node", "n", "popularity")
    entered = kept(entered, "tables")
    met = entered.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return entered.join(met.select("key"), "key")


def _merged(links: DataFrame) -> DataFrame:
    """``label, to``: the least label of the component, for all but least labels.

    Hooks every label to its least neighbour, follows hooks to their roots, and repeats on
    the links between roots.
    """
    edges = kept(links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u < v").distinct(), "edges")
    moved = None
    while edges.limit(1).count():
        hooks = kept(edges.groupBy("v").agg(F.min("u").alias("to")).select(F.col("v").alias("label"), "to"), "hooks")
        while True:
            up = hooks.select(F.col("label").alias("to"), F.col("to").alias("up"))
            further = hooks.join(up, "to", "left")
            jumped = kept(further.select("label", F.coalesce("up", "to").alias("to"), F.col("up").isNotNull().alias("went")), "hooks")
            done = jumped.filter("went").limit(1).count() == 0
            hooks = jumped.drop("went")
            if done:
                break
        moved = hooks if moved is None else kept(_relabelled(moved, "to", hooks).unionByName(hooks), "moved")
        edges = _relabelled(_relabelled(edges, "u", hooks), "v", hooks)
        edges = kept(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct(), "edges")
    return moved


def _relabelled(df: DataFrame, column: str, moves: DataFrame) -> DataFrame:
    named = moves.select(F.col("label").alias("_from"), F.col("to").alias("_to"))
    return df.join(named, F.col(column) == F.col("_from"), "left").withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b`` with both sets, dealt by ``a``: a centre of very many members is ``b``."""
    sent = pairs.select("a", "b").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
    return sent.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a").select("a", "b", "set_a", "set_b")


def _links(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """``a, b`` of the pairs (``a, b, n, m``) whose sets are alike."""
    shared = _with_sets(pairs, sets).mapInArrow(_shared, "a bigint, b bigint, both bigint")
    sized = shared.join(pairs.select("a", "b", (F.col("n") + F.col("m")).alias("nm")), ["a", "b"])
    return sized.filter(100 * F.col("both") >= threshold * (F.col("nm") - F.col("both"))).select("a", "b")


class _Labels:
    """The label of each class, the least number of its component so far; a table of changes."""

    def __init__(self):
        self.moved = None

    def merge(self, links: DataFrame) -> None:
        links = kept(links.select("a", "b"), "links")
        if self.moved is not None:
            links = _relabelled(_relabelled(links, "a", self.moved), "b", self.moved)
        moves = _merged(links)
        if moves is not None:
            self.moved = moves if self.moved is None else kept(_relabelled(self.moved, "to", moves).unionByName(moves), "labels")

    def of(self, df: DataFrame, node: str = "node") -> DataFrame:
        out = df.withColumn("label", F.col(node))
        return out if self.moved is None else _relabelled(out, "label", self.moved)

    def mixed(self, df: DataFrame, group: str) -> DataFrame:
        """Rows of groups with two labels or more, with ``label``."""
        named = kept(self.of(df), "named")
        several = named.groupBy(group).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select(group)
        return named.join(several, group)


def _groups(buckets: DataFrame) -> DataFrame:
    """``c, cn, node, n, popularity, shared`` once for each member of any bucket of centre c."""
    best = F.max_by(F.struct("node", "n"), F.struct("popularity", -F.col("node"))).alias("best")
    centres = buckets.groupBy("key").agg(best).select("key", F.col("best.node").alias("c"), F.col("best.n").alias("cn"))
    members = buckets.join(centres, "key").filter("node <> c")
    return members.groupBy("c", "node").agg(*(F.first(x).alias(x) for x in ("cn", "n", "popularity", "shared")))


def _need(slack) -> Column:
    """Residue shingles that two members must share for a likeness, from the sum of their slacks."""
    return F.greatest(F.lit(1), F.ceil(-slack / F.lit(2.0)))


def _ranked_residues(each: DataFrame) -> DataFrame:
    """Residue shingles that several members of a centre have: ``rank`` by rarity in the member's
    residue, of ``common`` such ones.  There is one row of a shingle and centre to look up, so no
    more rows come out than went in, whatever the size of a group."""
    several = each.groupBy("b", "shingle").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    member = Window.partitionBy("a", "b")
    return each.join(several, ["b", "shingle"]).withColumns({
        "rank": F.row_number().over(member.orderBy("f", "shingle")), "common": F.count(F.lit(1)).over(member)}).drop("f")


def _residue_pairs(group: DataFrame, sets: DataFrame, lone: DataFrame, threshold: int) -> DataFrame:
    """``a, b, n, m``: members of different labels that share enough of their rarest residue."""
    # the most slack of another label that each member can meet
    tops = group.groupBy("c", "label").agg(F.max("slack").alias("top"))
    tops = tops.groupBy("c").agg(F.max_by("label", F.struct("top", "label")).alias("first"), F.max("top").alias("most"), F.collect_list("top").alias("t"))
    tops = tops.select("c", "first", "most", F.get(F.array_sort("t", lambda x, y: F.when(x > y, -1).when(x < y, 1).otherwise(0)), F.lit(1)).alias("next"))
    other = F.when(F.col("label") == F.col("first"), F.col("next")).otherwise(F.col("most"))
    scale = 100 + threshold
    rows = group.join(tops, "c").withColumn("least", _need((F.col("slack") + other) / scale))
    # shingles of one class alone are in its residue and in no other
    rows = rows.withColumn("prefix", F.col("residue") - F.col("least") + 1).filter("prefix > 0 AND residue - (n - shared) >= least")
    several = rows.groupBy("c").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("c")
    rows = kept(rows.join(several, "c").select("c", "node", "n", "label", "slack", "residue", "shared", "prefix"), "reach")
    asked = rows.select(F.col("node").alias("a"), F.col("c").alias("b"), "prefix")
    asked = kept(asked.join(lone.select(F.col("node").alias("b"), F.col("own").alias("own_b")), "b", "left").join(
        lone.select(F.col("node").alias("a"), F.col("own").alias("own_a")), "a", "left"), "asked")
    each = _with_sets(asked, sets).join(asked, ["a", "b"]).mapInArrow(
        _residues, "a bigint, b bigint, shingle bigint, place bigint, late boolean")
    each = kept(each, "residues").withColumnsRenamed({"a": "node", "b": "c"})
    ranked = _ranked_residues(each.filter("NOT late").withColumnsRenamed({"node": "a", "c": "b"})).withColumnsRenamed({"a": "node", "b": "c"})
    # those that one member alone has come first in its residue
    ranked = ranked.withColumn("place", F.col("place") - F.col("common") + F.col("rank"))
    placed = ranked.select("c", "node", "shingle", "place").unionByName(each.filter("late").select("c", "node", "shingle", "place"))
    rare = kept(placed.join(rows, ["c", "node"]).filter("place <= prefix"), "rare")
    left = rare.select("c", "shingle", *(F.col(x).alias(f"{x}_a") for x in ("node", "n", "label", "slack", "residue", "shared", "place")))
    right = rare.select("c", "shingle", *(F.col(x).alias(f"{x}_b") for x in ("node", "n", "label", "slack", "residue", "shared", "place")))
    # from the first shared shingle on there must be enough left in both residues
    rest = 1 + F.least(F.col("residue_a") - F.col("place_a"), F.col("residue_b") - F.col("place_b"))
    met = (left["c"] == right["c"]) & (left["shingle"] == right["shingle"]) & (F.col("node_a") < F.col("node_b")) & (
        F.col("label_a") != F.col("label_b")) & (rest >= _need((F.col("slack_a") + F.col("slack_b")) / scale)) & _possible(
        threshold, F.col("n_a"), F.col("n_b"), F.col("shared_a"), F.col("shared_b"))
    pairs = left.join(right, met).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), F.col("n_a").alias("n"), F.col("n_b").alias("m"))
    return pairs.distinct()


def _possible(threshold: int, n: Column, m: Column, n_shared: Column, m_shared: Column) -> Column:
    """Sets of too different sizes cannot be alike, nor can those that have too much of their own."""
    return (100 * F.least(n, m) >= threshold * F.greatest(n, m)) & (threshold * (n + m) <= (100 + threshold) * F.least(n_shared, m_shared))


def components(docs: DataFrame, threshold: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document.

    ``threshold`` is the least likeness in hundredths.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = kept(texts.mapInArrow(_sketch, "doc_id bigint, set1 bigint, set2 bigint, n bigint, halves array<bigint>"), "sketches")
    filled = rows.filter("n > 0 AND doc_id IS NOT NULL")
    marks = ["set1", "set2", "n"]
    classes = filled.groupBy(*marks).agg(F.min("doc_id").alias("least"), F.any_value("halves").alias("halves"))
    classes = kept(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    buckets = kept(_buckets(classes), "buckets")
    wanted = classes.join(buckets.select("node").distinct(), "node", "left_semi").select(*marks, "node", "least")
    found = texts.join(wanted.select(F.col("least").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = found.mapInArrow(_sets, "set1 bigint, set2 bigint, n bigint, shingles binary").join(wanted.drop("least"), marks)
    sets = kept(sets.select("node", "shingles").dropDuplicates(["node"]), "sets")
    lone = _lone(sets)
    buckets = _shareable(buckets, lone, threshold)

    labels = _Labels()
    # a document of several texts has the links of each
    same = filled.select("doc_id", *marks).join(classes.select(*marks, "node"), marks).select("doc_id", "node").distinct()
    several = same.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b")
    labels.merge(same.join(several.select("doc_id", "a"), "doc_id").filter("a <> node").select("a", F.col("node").alias("b")))

    groups = kept(_groups(labels.mixed(buckets, "key")), "groups")
    shared = _with_sets(groups.select(F.col("node").alias("a"), F.col("c").alias("b")), sets).mapInArrow(_shared, "a bigint, b bigint, both bigint")
    groups = groups.join(shared.withColumnsRenamed({"a": "node", "b": "c"}), ["c", "node"])
    # the room that a member's residue leaves for another's, in units of 1 / (100 + threshold)
    residue = F.col("n") + F.col("cn") - 2 * F.col("both")
    groups = kept(groups.withColumn("residue", residue).withColumn("slack", (100 - threshold) * F.col("n") - (100 + threshold) * F.col("residue")), "groups")
    alike = 100 * F.col("both") >= threshold * (F.col("n") + F.col("cn") - F.col("both"))
    labels.merge(groups.filter(alike).select(F.col("c").alias("a"), F.col("node").alias("b")))

    # every member has met the centre; of the others, those of different labels are left
    open_ = kept(labels.mixed(groups, "c"), "open")
    best = open_.groupBy("c").agg(F.max_by(F.struct("node", "label", "slack"), F.struct("slack", -F.col("node"))).alias("best"))
    near = open_.join(best, "c").filter("slack + best.slack >= 0 AND label <> best.label")
    labels.merge(near.select(F.col("best.node").alias("a"), F.col("node").alias("b")))

    open_ = kept(labels.mixed(open_.drop("label"), "c"), "open")
    main = labels.of(open_.select("c").distinct().withColumn("node", F.col("c"))).select("c", F.col("label").alias("main"))
    outside = kept(open_.join(main, "c").filter("label <> main").drop("main"), "outside")
    order = Window.partitionBy("c").orderBy(F.desc("popularity"), "node")
    next_ = outside.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= FURTHER_CENTRES).select(
        "c", F.col("node").alias("d"), F.col("n").alias("m"), F.col("label").alias("dl"), F.col("shared").alias("ds"))
    met = outside.join(next_, "c").filter("label <> dl").filter(_possible(threshold, F.col("n"), F.col("m"), F.col("shared"), F.col("ds")))
    met = kept(met.select(F.col("d").alias("a"), F.col("node").alias("b"), "m", "n").distinct(), "met")
    labels.merge(_links(met, sets, threshold))

    open_ = kept(labels.mixed(open_.drop("label"), "c"), "open")
    pairs = kept(_residue_pairs(open_, sets, lone, threshold), "pairs")
    labels.merge(_links(pairs, sets, threshold))

    named = labels.of(classes.select(*marks, "node", "least"))
    first = named.groupBy("label").agg(F.min("least").alias("component_id"))
    owned = named.join(first, "label").select(*marks, "component_id")
    out = rows.select("doc_id", *marks).join(owned, marks, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_copies(docs: DataFrame, threshold: int = 80) -> DataFrame:
    """The documents of least id in their components; rows equal in id and text leave one,
    rows of one id and different texts all stay, as do rows without an id."""
    chosen = components(docs, threshold).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct()
    held = sealed(docs)
    named = held.join(chosen, F.col("doc_id").cast("bigint") == F.col("_id"), "left_semi")
    one = named.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id", "text").orderBy("source"))).filter("_k = 1").drop("_k")
    return unsealed(one.unionByName(held.filter("doc_id IS NULL")), docs.columns)
