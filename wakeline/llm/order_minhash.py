"""Document fingerprints by Order MinHash, in DataFrame functions only.

A text is cut into pieces (runs of non-space characters, twelve at most), a piece and the two
after it make a k-mer, and the k-th occurrence of a k-mer in the text is an element of its own.
Runs of ``LONG_RUN`` characters and more are first cut by content, before each place whose
four characters hash lower than those of the twelve places before and after it, so that an
edit moves the cuts of its surroundings only.  Where four characters come back within twelve
places over and over (one letter repeated), no place is the lowest and twelve are counted
from the last cut.
Elements fall into 64 groups by hash.  Each group contributes its two minimal elements in
the order in which they stand in the text, hashed as a tuple: moved text changes the tuples
although the set of k-mers stays, so likeness follows edit distance rather than overlap.

Likeness of two fingerprints is the share of equal tuples among the groups used by either.

Defined cases: a null text is an empty one; at the end of a text k-mers are shorter;
texts without a piece have the empty fingerprint, which is like itself (1.0) and unlike all
others; equal texts have equal fingerprints; repeated rows stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.common import bind

#: A piece and, looking ahead, the two after it: the k-mer that begins at the piece.
KMER = "(?=(\\S{1,12}\\s*\\S{0,12}\\s*\\S{0,12}))\\S{1,12}"
#: Content cuts: characters hashed at a place, places compared on either side, and the shortest run with such a place.
GRAM = 4
REACH = 12
LONG_RUN = 2 * REACH + GRAM
#: Marks a content cut; white space to ``KMER``.
CUT = "\x0b"
GROUP_BITS = 6
#: Low bits of a packed long that hold a position; a string has fewer pieces than that.
PLACE_BITS = 28
HIGH = -(1 << PLACE_BITS)
LOW = (1 << PLACE_BITS) - 1
TUPLE_BITS = 32 - GROUP_BITS
#: At most so many slices of the ids; the neighbour of a slice's last row comes from a table of this size.
MAX_SLICES = 1 << 20
IDS_PER_SLICE = 256


def _packed(hashed: Column, place: Column) -> Column:
    return hashed.bitwiseAND(F.lit(HIGH)).bitwiseOR(place.cast("bigint"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is read."""
    return F.get(F.transform(F.array(value), body), 0)


def _cut(run: Column) -> Column:
    """A long run with a mark at each content cut."""
    def marked(chars: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(chars) - GRAM), lambda i: F.xxhash64(F.concat(*(F.get(chars, i + k) for k in range(GRAM)))))

        def lowest(grams: Column, i: Column) -> Column:
            here = F.get(grams, i)
            inside = (i >= REACH) & (i < F.size(grams) - REACH)
            return inside & (here < F.array_min(F.slice(grams, F.greatest(i - REACH + 1, F.lit(1)), REACH))) & (
                here < F.array_min(F.slice(grams, i + 2, REACH)))

        return _let(grams, lambda g: F.array_join(F.transform(chars, lambda c, i: F.when(lowest(g, i), F.concat(F.lit(CUT), c)).otherwise(c)), ""))

    return _let(F.filter(F.split(run, ""), lambda c: c != ""), marked)


def content_cut(text: Column) -> Column:
    """The text with a mark at each content cut of its long runs."""
    long = f"\\S{{{LONG_RUN}}}"
    parts = F.split(text, f"(?<!\\S)(?={long})|(?<={long})(?!\\S)")
    return F.when(text.rlike(long), F.array_join(F.transform(parts, lambda p: F.when(p.rlike(f"^{long}"), _cut(p)).otherwise(p)), "")).otherwise(text)


def fingerprinted(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the fingerprint as an ascending array of group-tagged tuple hashes."""
    b = lambda d, name, value: bind(d, f"_{name}", value)
    high = lambda x: x.bitwiseAND(F.lit(HIGH))
    group = lambda x: F.shiftrightunsigned(x, 64 - GROUP_BITS)
    # arrays of longs are sorted in projections of their own, which compile to a primitive sort
    df = b(df, "cut", content_cut(F.col(text)))
    df = b(df, "kmers", F.transform(
        F.regexp_extract_all(F.col("_cut"), F.lit(KMER), F.lit(1)), lambda k, i: _packed(F.xxhash64(k), i)))
    df = df.withColumn("_kmers", F.sort_array("_kmers"))
    # where runs of equal k-mers begin
    df = b(df, "runs", F.filter(F.transform("_kmers", lambda x, i: F.when(
        (i == 0) | (high(x) != high(F.get(F.col("_kmers"), i - 1))), i)), lambda i: i.isNotNull()))
    # a first occurrence keeps the k-mer's hash; the n-th later one hashes it with n
    end = lambda j: F.coalesce(F.get(F.col("_runs"), j + 1), F.size("_kmers"))
    repeated = F.filter(F.transform("_runs", lambda s, j: F.when(end(j) > s + 1, F.struct(
        s.alias("s"), (end(j) - s - 1).alias("more")))), lambda r: r.isNotNull())
    later = F.flatten(F.transform(repeated, lambda r: F.transform(F.sequence(F.lit(1), r["more"]), lambda n: _packed(
        F.xxhash64(high(F.get(F.col("_kmers"), r["s"])), n),
        F.coalesce(F.get(F.col("_kmers"), r["s"] + n), F.lit(0).cast("bigint")).bitwiseAND(F.lit(LOW))))))
    df = b(df, "elements", F.when(F.size("_runs") == F.size("_kmers"), F.col("_kmers")).otherwise(F.concat(
        F.transform("_runs", lambda s: F.coalesce(F.get(F.col("_kmers"), s), F.lit(0).cast("bigint"))), later)))
    df = df.withColumn("_elements", F.sort_array("_elements"))
    df = b(df, "firsts", F.filter(F.transform("_elements", lambda x, i: F.when(
        (i == 0) | (group(x) != group(F.get(F.col("_elements"), i - 1))),
        F.struct(x.alias("a"), F.get(F.col("_elements"), i + 1).alias("b")))), lambda s: s.isNotNull()))

    def tuple_hash(s: Column) -> Column:
        a, b2 = s["a"], F.when(group(s["a"]) == group(s["b"]), s["b"])
        place = lambda x: x.bitwiseAND(F.lit(LOW))
        swapped = F.coalesce(place(a) > place(b2), F.lit(False))
        both = F.xxhash64(F.when(swapped, high(b2)).otherwise(high(a)), F.when(swapped, high(a)).otherwise(high(b2)))
        return F.shiftleft(group(a), TUPLE_BITS).bitwiseOR(F.shiftrightunsigned(both, 64 - TUPLE_BITS))

    df = b(df, "tuples", F.sort_array(F.transform("_firsts", tuple_hash)))
    return df.withColumn(out, F.col("_tuples")).drop(
        "_cut", "_kmers", "_runs", "_elements", "_firsts", "_tuples")


def likeness(a: Column, b: Column) -> Column:
    """Equal tuples over groups used by either fingerprint, between 0 and 1."""
    groups = lambda x: F.transform(x, lambda t: F.shiftrightunsigned(t, TUPLE_BITS))
    used = F.size(F.array_union(groups(a), groups(b)))
    return F.when(used == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / used)


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda t: F.lower(F.lpad(F.hex(t), 8, "0"))), "")


def with_next(df: DataFrame, carried: list[str], plain: DataFrame) -> DataFrame:
    """Add ``next_<c>`` of the row with the next doc_id (after the last: the first).

    ``plain`` has the doc_id and text that ``df`` has, and nothing that is dear to compute: the
    bounds and the first rows are read from it.  Ids are cut into slices; the first row of each slice also visits the slice before as a
    guest, so one pass over the wide rows suffices.  The table of first rows has at most
    ``MAX_SLICES`` narrow rows.
    """
    span = plain.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    lo, hi = (span["lo"] or 0), (span["hi"] or 0)
    width = max(IDS_PER_SLICE, -(-(hi - lo + 1) // MAX_SLICES))
    # null ids come first, in a slice of their own
    slice_of = F.coalesce(F.floor((F.col("doc_id") - lo) / width).cast("bigint"), F.lit(-1).cast("bigint"))
    tie = F.xxhash64("text")
    heads = plain.groupBy(slice_of.alias("_slice")).agg(F.min(F.struct(F.col("doc_id"), tie.alias("tie"))).alias("head"))
    order = Window.orderBy("_slice")
    edge = Window.partitionBy()
    heads = heads.select(
        F.coalesce(F.lag("_slice").over(order), F.max("_slice").over(edge)).alias("_host"),
        F.col("head.doc_id").alias("_head_id"), F.col("head.tie").alias("_head_tie"))
    rows = df.withColumns({"_slice": slice_of, "_tie": tie})
    guests = rows.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("_head_id")) & (F.col("_tie") == F.col("_head_tie")), "left")
    # a guest sorts after every row of the slice it visits
    seats = F.when(F.col("_host").isNull(), F.array(F.struct(F.col("_slice").alias("s"), F.lit(0).alias("g")))).otherwise(
        F.array(F.struct(F.col("_slice").alias("s"), F.lit(0).alias("g")), F.struct(F.col("_host").alias("s"), F.lit(1).alias("g"))))
    seated = guests.withColumn("_seat", F.explode(seats))
    w = Window.partitionBy("_seat.s").orderBy("_seat.g", F.col("doc_id").asc_nulls_first(), "_tie")
    out = seated.withColumns({f"next_{c}": F.lead(c).over(w) for c in carried})
    return out.filter("_seat.g = 0").drop("_slice", "_tie", "_host", "_head_id", "_head_tie", "_seat")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has the last quarter of the code points replaced by the first as many
    (or all) of the next document by doc_id.
    """
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = with_next(fingerprinted(df, "text", "_own"), ["text", "_own"], df)
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    df = bind(df, "edited", F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter)))
    df = fingerprinted(df, "edited", "_edited")
    return df.select(
        "doc_id", n.cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("_own")).alias("fingerprint"), as_text(F.col("_edited")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_edited")).alias("near_edited"),
        likeness(F.col("_own"), F.col("next__own")).alias("near_next"))
