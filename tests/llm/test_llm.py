"""The training-data operators against DuckDB, brute force and defined edge cases."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import check
from wakeline.llm import (
    common,
    encoding,
    licenses,
    line_frequency,
    near_duplicates,
    order_minhash,
    packing,
    passages,
    perspectives,
    queries,
    schedule,
    token_counts,
    url_filter,
)
from wakeline.llm.column_bwt import column_wise

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SPACE = "[\x20\x09-\x0d]+"
WORD = "[^\x20\x09-\x0d]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows):
    """(doc_id, text, source) rows as documents with columns that clash with inner names."""
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)
    for name in ("row", "queue", "mark", "left", "hash", "key", "node", "_mark", "_k", "cut", "host", "_extra", "words"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def some_texts(seed=3, n=60):
    """Prose of a small vocabulary with copies, near copies, shared passages and odd texts."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choice(words) + rng.choice(["", "", ",", ".\n"]) for _ in range(k))
    passage = prose(60)
    rows = []
    for i in range(n):
        text = prose(rng.choice([3, 40, 120, 200]))
        if i % 3 == 0:
            text += " " + passage + " " + prose(10)
        if i % 7 == 0 and rows:
            text = rows[rng.randrange(len(rows))][1]
        if i % 5 == 0 and rows:
            parts = (rows[rng.randrange(len(rows))][1] or "").split(" ")
            if len(parts) > 30:
                parts[rng.randrange(len(parts))] = "changed"
                text = " ".join(parts)
        rows.append((i * 3, text, rng.choice(["a", "a", "a", "b", None])))
    return rows + [(1000, "", "b"), (1001, None, "c"), (1002, " \t\n", "a"), (1003, "one", "é"),
                   (1004, "x" * 700, "a"), (1005, "<|endoftext|> a <|startoftext|>b", "b"), (1006, "é" * 300, "b"),
                   (1007, "naïve café’s don't DON'T 12a\u0301 \n\n  end  ", "a")]


def rows_of(df, key="doc_id"):
    out = {}
    for r in df.collect():
        assert r[key] not in out
        out[r[key]] = r
    return out


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, con, name):
    status, note, _ = check.compare(name, queries.QUERIES[name](spark, SF), queries.ORACLES[name], con)
    assert status == "ok", note


def test_all_operators_are_registered():
    assert [sum(q.startswith(f"op{n}_") for q in queries.QUERIES) for n in range(1, 14)] == [1] * 13


# 1: perspective rotation

def test_rotation_renders_every_participant(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", "ok"), (1, 3, "ann", "ok"),
            (None, None, None, "lost"), (2, 0, "system", "alone")]
    got = perspectives.rotate(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("start", F.lit(1))).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r.start):
        by[r.conv_id, r.speaker].append(r)
    assert set(by) == {(1, "ann"), (1, "bob"), (None, "unknown")}
    whole = "".join(r.rendered for r in by[1, "bob"])
    assert whole == ("<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user name=ann\nhi<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
                     + 2 * "<|im_start|>user name=ann\nok<|im_end|>\n")
    ann = by[1, "ann"]
    whole = "".join(r.rendered for r in ann)
    assert [whole[r.mask_from:r.mask_to] for r in ann] == ["", "hi<|im_end|>", "", "ok<|im_end|>", "ok<|im_end|>"]
    assert perspectives.rotate(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


# 2: order MinHash

def xx(*values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else (v & (2**64 - 1)).to_bytes(8, "little"), h)
    return h


def brute_fingerprint(text):
    low, mask = (1 << 28) - 1, (1 << 64) - 1
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    kmers = [m.group(1) for m in re.finditer(r"(?=([^\t-\r ]{1,12}[\t-\r ]*[^\t-\r ]{0,12}[\t-\r ]*[^\t-\r ]{0,12}))[^\t-\r ]{1,12}", text)]
    seen, elements = defaultdict(int), []
    for place, k in enumerate(kmers):
        h = xx(k) & (mask ^ low)
        n = seen[h]
        seen[h] += 1
        if n:  # the number of an occurrence is an int: four bytes
            h = xxhash.xxh64_intdigest((n).to_bytes(4, "little"), xx(h)) & (mask ^ low)
        elements.append(h | place)
    groups = defaultdict(list)
    for e in sorted(elements, key=signed):
        groups[e >> 58].append(e)
    out = []
    for g, es in groups.items():
        two = sorted(es[:2], key=lambda e: e & low)
        out.append(g << 26 | xx(*(e & (mask ^ low) for e in two)) >> 38)
    return sorted(out)


def test_fingerprints_match_brute_force_and_follow_edits(spark):
    rows = some_texts()
    got = rows_of(order_minhash.compare_edited(docs(spark, rows)))
    ids = sorted(got)
    text = {i: t or "" for i, t, _ in rows}
    fp = {i: brute_fingerprint(text[i]) for i in ids}
    like = lambda a, b: 1.0 if not (a or b) else len(set(a) & set(b)) / len({x >> 26 for x in a} | {x >> 26 for x in b})
    for i, after in zip(ids, ids[1:] + ids[:1], strict=True):
        n = len(text[i])
        edited = text[i][: n - n // 4] + text[after][: n // 4]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == "".join(f"{x:08x}" for x in fp[i]), text[i][:80]
        assert r.edited_fingerprint == "".join(f"{x:08x}" for x in brute_fingerprint(edited))
        assert r.near_edited == pytest.approx(like(fp[i], brute_fingerprint(edited)))
        assert r.near_next == pytest.approx(like(fp[i], fp[after]))
    # moved text keeps its k-mers but not its tuples
    words = [f"w{i}" for i in range(400)]
    moved = words[200:] + words[:200]
    a, b = brute_fingerprint(" ".join(words)), brute_fingerprint(" ".join(moved))
    assert like(a, b) < 0.8


def test_fingerprint_edge_cases(spark):
    assert order_minhash.compare_edited(docs(spark, [])).count() == 0
    one = order_minhash.compare_edited(docs(spark, [(5, "abcdefgh", "a")])).collect()[0]
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    twice = order_minhash.compare_edited(docs(spark, [(5, "a b", "a"), (5, "a b", "a"), (None, None, None)])).collect()
    assert len(twice) == 3


def test_one_character_moves_few_cuts_of_an_unspaced_text(spark):
    rng = random.Random(5)
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    texts = [some("".join(map(chr, range(0x4E00, 0x5200))), 3000), some("ABCDEFGHabcdefgh0123456789+/", 3000),
             "spaced words " + some("abcdef()={};", 3000) + "\nand more", some("\U00020000\U00020001\U00020002é", 3000)]
    edits = [lambda t: "a" + t, lambda t: t[1:], lambda t: t[:20] + "é" + t[20:], lambda t: t[:1500] + t[1501:]]
    rows = [(t, edit(t)) for t in texts for edit in edits]
    df = spark.createDataFrame(rows, "a string, b string")
    df = order_minhash.fingerprinted(order_minhash.fingerprinted(df, "a", "fa"), "b", "fb")
    assert min(r[0] for r in df.select(order_minhash.likeness(F.col("fa"), F.col("fb"))).collect()) > 0.8
    # cuts take nothing away, need a long run, and do not depend on what stands before
    text = texts[0]
    marked = spark.createDataFrame([(text,), ("字" + text,), ("x" * 700,), ("a" * 27 + " b\n",)], "t string").select(order_minhash.content_cut(F.col("t"))).collect()
    assert marked[0][0].replace("\x0b", "") == text and 80 < marked[0][0].count("\x0b") < 240
    assert marked[1][0].split("\x0b")[2:] == marked[0][0].split("\x0b")[2:] or marked[1][0].split("\x0b")[2:] == marked[0][0].split("\x0b")[1:]
    assert [marked[2][0], marked[3][0]] == ["x" * 700, "a" * 27 + " b\n"]


# 3: packing

def test_packing_places_every_id_once(spark):
    rows = some_texts()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for i, x, _ in rows}
    window = 256
    got = packing.pack(docs(spark, rows), window=window, unit=64).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start: r.start + r.length].tobytes())
        assert r.doc_tokens == len(ids[r.doc_id])
    assert set(by) == set(ids)
    for i, pieces in by.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids[i])
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    total = sum(map(len, ids.values()))
    assert sorted(sequences) == list(range(-(-total // window)))
    for s, held in sequences.items():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at == window or s == max(sequences)
    # the mixture: after any window each queue has sent its share but for a unit or so
    source = {i: s for i, _, s in rows}
    share = defaultdict(float)
    for i, x in ids.items():
        share[source[i]] += len(x) / total
    sent = defaultdict(int)
    for s in sorted(sequences)[:-1]:
        for r in got:
            if r.sequence_id == s:
                sent[source[r.doc_id]] += r.length
        for q, p in share.items():
            assert abs(sent[q] - p * window * (s + 1)) <= 2 * 64 + window * p + 64


def test_packing_edge_cases(spark):
    assert packing.pack(docs(spark, [])).count() == 0
    got = packing.pack(docs(spark, [(1, None, None), (1, None, None)])).collect()
    assert sorted((r.length, r.offset) for r in got) == [(1, 0), (1, 1)]


# 4: line frequency

def test_common_lines_go_and_depleted_documents_too(spark):
    line = "Subscribe to OUR   letter 12 now and get all the news"
    own = "each text here has enough of its own words to stay number "
    other = lambda i: own + " ".join("w" * (i + 1) + "x" * k for k in range(12))
    rows = [(i, f"{line.upper() if i % 2 else line}\n{other(i)}", "a") for i in range(30)]
    rows += [(100, line + "\nshort", "a"), (101, line + "\n" + other(7), "b"), (102, None, None), (103, "", "a")]
    got = rows_of(line_frequency.verdicts(docs(spark, rows)))
    assert all(got[i].kept and got[i].n_removed_words == 11 for i in range(30))
    assert not got[100].kept and not got[100].base_failed
    assert got[101].kept and got[101].n_removed_words == 0
    assert got[102].base_failed and got[103].base_failed
    left = rows_of(line_frequency.cleaned(docs(spark, rows)))
    assert set(left) == {*range(30), 101}
    assert left[4].text == other(4) and left[4].n_chars == len(other(4)) and left[4].mark == "clash"
    assert line_frequency.verdicts(docs(spark, [])).count() == 0
    copied = [(200 + i, other(3) + "\nand a second line of the copied text", "a") for i in range(40)]
    assert all(r.kept and r.n_removed_words == 0 for r in line_frequency.verdicts(docs(spark, copied + rows)).collect() if r.doc_id >= 200)
    twice = line_frequency.verdicts(docs(spark, [(1, "a b\na b", "x")] * 2)).collect()
    assert [r.n_dup_lines for r in twice] == [1, 1]


# 5: token counts

def test_counts_and_ids_are_those_of_the_library(spark):
    rows = some_texts()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = rows_of(token_counts.token_counts(docs(spark, rows)))
    for i, text, _ in rows:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 512)
    assert token_counts.token_counts(docs(spark, [])).count() == 0


def test_units_begin_at_safe_boundaries():
    import pyarrow as pa

    data, bounds = encoding.flat(pa.array(["ab, c  d", None, "é x", "a'b\u00a0 c"]))
    starts = encoding.unit_starts(data, bounds).tolist()
    assert starts == [0, 2, 3, 5, 8, 10, 12, 13]
    assert list(encoding.runs(pa.array(["aaaa", "b", "cc", "d" * 9, ""]), 5)) == [(0, 2), (2, 3), (3, 4), (4, 5)]


# 6: repeated passages

def brute_passages(rows):
    seen, out = set(), {}
    for i, t in sorted(((i, t or "") for i, t, _ in rows)):
        b = t.encode()
        mark = bytearray(len(b))
        for k in range(len(b) - 99):
            w = b[k:k + 100]
            if w in seen:
                mark[k:k + 100] = b"\1" * 100
            seen.add(w)
        left = bytes(c for c, m in zip(b, mark, strict=True) if not m)
        runs = len(re.findall(b"\1+", bytes(mark)))
        out[i] = (len(b), sum(mark), runs, hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("limits", [{}, {"hot_in_task": 2, "hot_pieces": 3}])
def test_passages_match_brute_force(spark, limits):
    rows = [*some_texts(seed=8, n=80), (2000, "ab" * 400, "a"), (2001, "ab" * 300 + "c", "a")]
    want = brute_passages(rows)
    got = rows_of(passages.digests(docs(spark, rows).repartition(3), **limits))
    assert {i: tuple(r)[1:] for i, r in got.items()} == want
    assert sum(v[1] for v in want.values()) > 5000


def test_passages_shuffle_texts_once(spark):
    """Fetching pieces and cutting texts read one shuffle of the documents."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for step in (passages.digests, passages.without_repeats):
            left = step(docs(spark, some_texts()).repartition(3))
            assert left.collect()
            assert "ReusedExchange" in left._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_stored_tables_leave_no_shuffle_files(spark):
    """Shuffle files of a finished write would stay until the driver's garbage is collected."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in manager.getAllFiles().mkString("\n").split("\n") if f.endswith(".data") and "/shuffle_" in f}
    was, setting = shuffled(), spark.conf.get(common.CLEANUP, None)
    once = common.kept(spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).count(), "counts", cleanup=True)
    twice = common.kept(once.repartition("count"), "counts", cleanup=True)
    for _ in range(50):
        if shuffled() <= was:
            break
        time.sleep(0.2)
    assert shuffled() <= was
    assert once.count() == twice.count() == 1000
    assert spark.conf.get(common.CLEANUP, None) == setting


def test_passages_edge_cases(spark):
    text = " ".join(f"word{i}" for i in range(60))
    got = passages.digests(docs(spark, [(1, text, "a"), (1, text, "a"), (1, text + "x", "a"), (None, text, "a")])).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in got) == [(False, len(text)), (False, len(text)), (False, len(text)), (True, 0)]
    assert passages.digests(docs(spark, [])).count() == 0
    left = rows_of(passages.without_repeats(docs(spark, [(1, text, "a"), (2, "new " + text, "a"), (3, text, "b"), (4, None, None)])))
    assert left[2].text.strip() == "new" and left[2].n_chars == len(left[2].text) and set(left) == {1, 2, 4}
    assert left[1].text == text and left[1].mark == "clash"


def test_long_texts_are_worked_on_in_stretches(spark, monkeypatch):
    import pyarrow as pa

    rng = random.Random(1)
    text = "".join(rng.choice("abcd ") for _ in range(5000))
    monkeypatch.setattr(passages, "STRETCH", 700)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["doc_id", "text"])
    found = passages._batch_pieces(batch, np.zeros(0, np.int64))
    covered = sorted((s, s + w) for s, w in zip(found["start"].tolist(), found["windows"].tolist(), strict=True))
    assert covered[0][0] == 0 and covered[-1][1] == 5000 - 99
    assert all(a[1] == b[0] for a, b in zip(covered, covered[1:], strict=False))


def test_only_pieces_that_may_share_a_window_are_constructed(monkeypatch):
    import pyarrow as pa

    rng = random.Random(4)
    some = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    common = [some(rng.randint(24, 130)) for _ in range(12)]
    texts = [b"".join(part for _ in range(6) for part in (some(rng.randint(40, 160)), rng.choice(common))) for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array([t.decode() for t in texts])], ["doc_id", "text"])
    first, _ = passages._settled(passages._batch_pieces(batch, np.zeros(0, np.int64)))
    held = [texts[d][s: s + w + 99] for d, s, w in zip(first["doc"].tolist(), first["start"].tolist(), first["windows"].tolist(), strict=True)]
    rows = pa.RecordBatch.from_arrays([*(pa.array(first[k]) for k in ("key", "doc", "start")), pa.array(held, pa.binary())], ["key", "doc", "start", "bytes"])
    built, whole = [], passages.column_wise

    def counted(data, starts, ends, depth):
        built.append(len(starts))
        return whole(data, starts, ends, depth)

    monkeypatch.setattr(passages, "column_wise", counted)
    found = {(d, k) for b in passages._constructed(iter([rows])) for d, s, w in zip(*(c.to_pylist() for c in b.columns), strict=True) for k in range(s, s + w)}
    seen, want = set(), set()
    for d, s, piece in sorted(zip(first["doc"].tolist(), first["start"].tolist(), held, strict=True)):
        for k in range(len(piece) - 99):
            if piece[k: k + 100] in seen:
                want.add((d, s + k))
            seen.add(piece[k: k + 100])
    assert found == want and len(want) > 200
    pieces = Counter(first["key"].tolist())
    shared = sum(n for n in pieces.values() if n > 1)
    assert 0 < sum(built) < shared


def test_column_wise_construction():
    rng = np.random.default_rng(5)
    for _ in range(20):
        size = rng.integers(1, 30, rng.integers(1, 7))
        texts = [bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in size]
        data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size)
        bwt, at, shares = column_wise(data, ends - size, ends, 6)
        suffixes = sorted((t[j:], i, ends[i] - size[i] + j) for i, t in enumerate(texts) for j in range(len(t) + 1))
        owner = np.repeat(np.arange(len(size)), size)
        found = [bytes(data[a: ends[owner[a]]]) for a in at[len(size):]]
        assert found == [s for s, _, _ in suffixes][len(size):]
        assert bwt[len(size):].tolist() == [0 if a in (ends - size) else data[a - 1] + 1 for a in at[len(size):]]
        every = [b""] * len(size) + found
        assert shares.tolist() == [k > 0 and len(x) >= 6 and x[:6] == every[k - 1][:6] for k, x in enumerate(every)]


# 7: mixing

def test_mix_keeps_to_targets(spark):
    rows = some_texts()
    got = schedule.mix(docs(spark, rows)).collect()
    source = {i: s for i, _, s in rows}
    size = {i: len(re.findall(WORD, t or "")) for i, t, _ in rows}
    taken, target, total = defaultdict(int), {}, sum(size.values())
    for r in got:
        assert r.size == size[r.doc_id] and 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert r.target <= 2 * r.source_size + 1e-9
    assert sum(target.values()) == pytest.approx(1.5 * total)
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    again = schedule.mix(docs(spark, rows).repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert schedule.mix(docs(spark, [])).count() == 0


def test_schedule_is_evenly_mixed(spark, monkeypatch):
    monkeypatch.setattr(schedule, "BLOCK_WORDS", 16)
    rows = schedule.sized(docs(spark, some_texts()))
    plan, _, n = schedule._planned(rows)
    slots = [r for r in schedule.slots(plan, n, spark).collect()]
    want = {r.queue: r.slots for r in plan.collect()}
    per = defaultdict(list)
    for s in slots:
        per[s.queue].append(s)
    for q, k in want.items():
        assert sorted(s.rank for s in per[q]) == list(range(k))
    half = [s for s in slots if s.slot is not None and s.slot < n // 2]
    for q, k in want.items():
        assert abs(sum(s.queue == q for s in half) - k / 2) <= 4


def test_mixed_documents_carry_what_was_taken(spark):
    rows = [*some_texts(), (5, "same row", "a"), (5, "same row", "a")]
    taken = defaultdict(int)
    for r in schedule.mix(docs(spark, rows)).collect():
        taken[r.doc_id] += r.taken
    got = schedule.mixed_documents(docs(spark, rows)).collect()
    words = defaultdict(int)
    text = {i: t for i, t, _ in rows}
    for r in got:
        words[r.doc_id] += len(re.findall(WORD, r.text))
        assert text[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) and r.mark == "clash"
    assert {i: n for i, n in taken.items() if n} == dict(words)


# 8: URLs

def test_urls_are_judged(spark):
    urls = ["https://www.Bad.org/x/", "http://bad.org/x?q=1", "http://bad.org/y", "http://a.net", "http://a.net/", "http://m.example.net/en/1",
            "http://example.com/de/", "http://notexample.com/de/", "nothing", None, "http://bad.org/x/", "x://org/fr/?://net/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("rule", F.lit("clash"))
    listing = spark.createDataFrame([("bad.org/x",), ("bad.org/x",), ("",)], "canonical string")
    got = rows_of(url_filter.judge(pages, listing, queries.URL_RULES), "page_id")
    assert [got[i].verdict for i in range(len(urls))] == [
        "block", "block", "allow", "allow", "block", "allow", "block", "allow", "allow", "allow", "block", "allow"]
    assert (got[9].host, got[9].path, got[0].host, got[11].rule) == ("", "", "www.bad.org", "org/fr/")
    assert all(r.maybe for r in got.values() if r.listed)
    assert url_filter.judge(pages, listing.limit(0), queries.URL_RULES).filter("listed OR maybe").count() == 0


def test_bloom_blocks_pass_all_listed_and_few_others(spark):
    listed = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("canonical"))
    blocks = 3000 * url_filter.BITS_PER_KEY // url_filter.BLOCK_BITS
    bloom = url_filter.bloom_blocks(listed, "canonical", blocks)
    asked = spark.range(6000).select("id", F.concat(F.lit("k"), "id").alias("canonical"))
    got = url_filter.possible(asked, "canonical", bloom, blocks).filter("maybe")
    assert got.filter("id < 3000").count() == 3000 and got.filter("id >= 3000").count() < 60


# 9: near-duplicates

def brute_components(rows, threshold):
    sets = {}
    for i, t, _ in rows:
        w = re.findall(WORD, (t or "").translate(LOWER))
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= threshold * len(sets[i] | sets[j]):
                    a, b = sorted((find(i), find(j)))
                    parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("threshold", [80, 85])
def test_components_match_brute_force(spark, threshold):
    rng = random.Random(11)
    rows = some_texts(seed=4, n=90)
    base = [f"t{rng.randrange(500)}" for _ in range(200)]
    for k in range(60):  # near copies of one text, most of which are only like the original
        edited = list(base)
        for _ in range(3):
            edited[rng.randrange(len(edited))] = f"e{rng.randrange(10**6)}"
        rows.append((3000 + k, " ".join(edited), "a"))
    rows.append((4000, " ".join(base), "b"))
    chain = list(base[:100])
    for k in range(12):  # a chain whose ends are not alike
        chain[k * 8] = f"c{k}"
        rows.append((5000 + k, " ".join(chain).upper(), "a"))
    want = brute_components(rows, threshold)
    got = rows_of(near_duplicates.components(docs(spark, rows), threshold))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items())
    left = near_duplicates.without_copies(docs(spark, rows), threshold)
    assert {r.doc_id for r in left.collect()} == {i for i, (_, c) in want.items() if i == c} and left.columns[-1] == "words"


def test_component_edge_cases(spark):
    assert near_duplicates.components(docs(spark, [])).count() == 0
    rows = [(1, "a b", "x"), (2, "A B", "x"), (3, None, "x"), (None, "a b", "x"), (4, "a b", "x"), (4, "c d e", "x"), (5, "C d e", "x")]
    got = near_duplicates.components(docs(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [
        (0, 0, True), (1, 1, True), (2, 1, False), (3, 3, True), (4, 1, False), (4, 1, False), (5, 1, False)]


def test_documents_of_several_texts_keep_the_links_of_each(spark):
    words = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    near = words("a", 104)
    rows = [(5, near, "x"), (5, words("b", 304), "x"), (7, near.replace("a103", "other"), "x"),
            (21, words("p", 30), "x"), (30, words("q", 30), "x"), (35, words("r", 30), "x"),
            (40, words("p", 30), "x"), (40, words("q", 30), "x"), (40, words("r", 30), "x")]
    got = near_duplicates.components(docs(spark, rows), 85).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 5), (7, 5), (21, 21), (30, 21), (35, 21), (40, 21)}


def test_long_texts_hash_alike_in_stretches(monkeypatch):
    import pyarrow as pa

    rng = random.Random(2)
    text = " ".join("w" * rng.randrange(1, 9) + str(rng.randrange(99)) for _ in range(900)) + " " + "y" * 900 + " end"
    whole = near_duplicates.shingle_sets(pa.array([text]))
    monkeypatch.setattr(near_duplicates, "STRETCH", 500)
    parts = near_duplicates.shingle_sets(pa.array([text]))
    assert (whole[0] == parts[0]).all() and len(whole[0]) == len({tuple(text.split()[i:i + 5]) for i in range(len(text.split()) - 4)})


# 10: licences

def test_licenses_are_inherited_from_the_nearest_directory(spark):
    rows = [(1, "/a/LICENSE", "x\nReleased under the MIT License."), (2, "/a/b/COPYING.txt", "Licensed under the Apache License, Version 2.0."),
            (3, "/a/b/c/f.py", "code\n"), (4, "/a/z/f.py", None), (5, "/a/b/g.py", "This work is licensed under the GNU General Public License, version 3."),
            (6, "/q/f.py", "license plate of a car that was parked in the yard near the house"), (7, None, "text"), (8, "/ab/f.py", "")]
    files = spark.createDataFrame(rows, "doc_id bigint, path string, text string").withColumns({"dir": F.lit("clash"), "line": F.lit("clash")})
    got = rows_of(licenses.scan(files))
    assert {i: (r.own_license, r.inherited_license, r.inherited_from, r.license) for i, r in got.items()} == {
        1: ("MIT", "MIT", "/a", "MIT"), 2: ("Apache-2.0", "Apache-2.0", "/a/b", "Apache-2.0"),
        3: (None, "Apache-2.0", "/a/b", "Apache-2.0"), 4: (None, "MIT", "/a", "MIT"), 5: ("GPL-3.0", "Apache-2.0", "/a/b", "GPL-3.0"),
        6: (None, None, None, None), 7: (None, None, None, None), 8: (None, None, None, None)}
    assert licenses.scan(files.limit(0)).count() == 0


def test_every_notice_of_the_tables_has_its_license_at_any_collection_size(spark):
    notices = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT",
               "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
               "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "All rights reserved.": "Proprietary"}
    seen = set()
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        lines = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select(F.explode(F.split("text", "\n")).alias("line"))
        seen |= {r.line for r in lines.filter(F.col("line").rlike(licenses.HEADER)).distinct().collect()}
    assert seen == set(notices)
    more = {"Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "CC-BY-NC-4.0",
            "Copyright (c) 2019 Foo. All rights reserved.": "Proprietary", "BSD 3-Clause License": "BSD-3-Clause",
            "# Licensed under the Apache License, Version 2.0 (the \"License\");": "Apache-2.0", "Licensed under the Foo License": None, "License": None}
    given = list((notices | more).items())
    rows = [(0, "/LICENSE", "Released under the MIT License.")] + [(i, f"/d/{i}.txt", line) for i, (line, _) in enumerate(given, 1)]
    files = lambda rows: spark.createDataFrame(rows, "doc_id bigint, path string, text string")
    small = rows_of(licenses.scan(files(rows)))
    assert {line: small[i].own_license for i, (line, _) in enumerate(given, 1)} == dict(given)
    assert all(small[i].license == (name or "MIT") for i, (_, name) in enumerate(given, 1))
    large = rows_of(licenses.scan(files(rows + [(i, f"/e/{i}.txt", rows[i % 5][2]) for i in range(100, 1500)])))
    assert all(large[i] == small[i] for i in small)
    # reserved rights beside a granted licence do not hide it
    both = "Copyright (c) All rights reserved\nUse of this code is governed by a BSD style license"
    assert licenses.scan(files([(1, "/f.py", both)])).first().license == "BSD-3-Clause"


def test_license_files_are_compared_as_a_whole_and_spdx_headers_name_themselves(spark):
    texts = dict(licenses.license_texts())
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0"} <= set(texts)
    untitled = {name: text[text.index("\n", text.index("\n", 40) + 1):] for name, text in texts.items()}
    untitled["MIT"] = texts["MIT"][texts["MIT"].index("Permission"):]
    untitled["BSD-3-Clause"] = "Copyright (c) 2001 Somebody Else\nAll rights reserved.\n" + texts["BSD-3-Clause"][texts["BSD-3-Clause"].index("Redistribution"):]
    heads = {"// SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "# SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0",
             "/* SPDX-License-Identifier: mit */": "MIT", "<!-- SPDX-License-Identifier: LGPL-3.0+ -->": "LGPL-3.0",
             "SPDX-License-Identifier: ISC": "ISC", "SPDX-License-Identifier: (MIT OR GPL-3.0-only)": "(MIT OR GPL-3.0)",
             "Subject to the terms of the license,\nthe Mozilla Public License,\nversion 2.0 of the license": "MPL-2.0"}
    rows = [(i, f"/{name}/LICENSE", text) for i, (name, text) in enumerate(untitled.items())]
    rows += [(100 + i, f"/{name}/src/x.py", "code") for i, name in enumerate(untitled)]
    rows += [(200 + i, f"/MIT/{i}.py", text) for i, text in enumerate(heads)]
    rows += [(300, "/MIT/prose.txt", texts["GPL-3.0"].lower().replace("license", "").replace("copyright", "")), (301, "/own/LICENSE", "of the people and for the people " * 50), (302, "/null/LICENSE", None)]
    got = rows_of(licenses.scan(spark.createDataFrame(rows, "doc_id bigint, path string, text string")))
    assert {n: got[i].own_license for i, n in enumerate(untitled)} == {n: n for n in untitled}
    assert {n: got[100 + i].license for i, n in enumerate(untitled)} == {n: n for n in untitled}
    assert {h: got[200 + i].own_license for i, h in enumerate(heads)} == heads
    assert [got[i].own_license for i in (300, 301, 302)] == [None, None, None]


# the pipeline

def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    given = spark.read.parquet(f"{SF}/documents.parquet")
    table, before = given, given
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, table, SF).write.parquet(str(tmp_path / name))
        before, table = table, spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert table.dtypes == given.dtypes
        was = {r.doc_id: r.text for r in before.collect()}
        if name == "quality_rules":
            kept = {r.doc_id for r in line_frequency.verdicts(before).filter("kept").collect()}
            assert {r.doc_id for r in table.collect()} == kept
        elif name == "near_copies":
            want = brute_components([(i, t, None) for i, t in was.items()], 80)
            assert {r.doc_id for r in table.collect()} == {i for i, (_, c) in want.items() if c == i}
            assert all(was[r.doc_id] == r.text for r in table.collect())
        elif name == "repeated_passages":
            want = brute_passages([(i, t, None) for i, t in was.items()])
            for r in table.collect():
                assert was[r.doc_id] == r.text if want[r.doc_id][1] == 0 else len(r.text.encode()) <= want[r.doc_id][0] - want[r.doc_id][1]
            gone = set(was) - {r.doc_id for r in table.collect()}
            assert all(want[i][0] - want[i][1] < 4 for i in gone)
        elif name == "source_mix":
            taken = {r.doc_id: r.taken for r in schedule.mix(before).collect() if r.taken}
            words = defaultdict(int)
            for r in table.collect():
                words[r.doc_id] += len(re.findall(WORD, r.text))
            assert words == taken
        else:
            t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            ids = sum(len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in before.collect())
            assert sum(r.length for r in table.collect()) == ids
