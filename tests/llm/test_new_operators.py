"""Line deduplication, phrase collocations and whitening against brute force and edge cases."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import DOCS, LOWER, docs
from wakeline.llm import near_duplicates, phrases, shared_lines, whitening

BLANK = " \t\n\x0b\x0c\r"


def line_texts():
    rng = random.Random(5)
    lines = [f"Line {i} of some é words that are long enough to count" for i in range(12)] + ["short", "", " ", "x" * 39, "Y" * 40]
    rows = []
    for i in range(60):
        own = [f"own line {i} {k} with enough characters to be a key" for k in range(2)]
        held = [rng.choice(["", "  ", "\t", "\r"]) + rng.choice([str.upper, str, str])(rng.choice(lines)) + rng.choice(["", " ", "\x0b"])
                for _ in range(rng.randint(0, 9))]
        rows.append((i, "\n".join([*own[: rng.randint(0, 2)], *held]), "a"))
    return [*rows, (100, None, "a"), (101, "", "a"), (102, "\n", "b"), (103, "\n\n" + "z" * 50 + "\n", "b"), (104, "z" * 50, "b"), (105, "z" * 50, "b")]


def expected_lines(rows, least=5):
    key = lambda line: line.strip(BLANK).translate(LOWER)
    held = defaultdict(set)
    for i, text, _ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                held[key(line)].add(-1 if i is None else i)
    out = []
    for i, text, _ in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if not (len(held.get(key(x), ())) >= least and (-1 if i is None else i) < max(held[key(x)]))]
        out.append((i, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest(), "\n".join(left)))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v if v is not None else 0) for v in r))


def test_frequent_lines_stay_in_the_last_document_only(spark):
    rows = line_texts()
    want = expected_lines(rows)
    assert sum(w[2] for w in want) > 50
    assert order(tuple(r) for r in shared_lines.digests(docs(spark, rows)).collect()) == order(w[:4] for w in want)
    out = shared_lines.deduplicated(docs(spark, rows))
    assert out.columns == docs(spark, rows).columns
    texts = {r["doc_id"]: (r["text"], r["_extra"]) for r in out.collect()}
    assert texts == {w[0]: (None if w[0] == 100 else w[4], "clash") for w in want}


def test_line_edge_cases(spark):
    z = "z" * 45
    rows = [(None, z, "a"), (None, z + "\nb", "a"), (1, z + "\n" + z, "a"), (2, z, "a"), (3, z, None), (3, z, None), (3, "other\n" + z, None), (4, z + "\n" + z, "b")]
    want = expected_lines(rows)
    assert want[-1][2] == 0 and want[0][2] == 1
    assert order(tuple(r) for r in shared_lines.digests(docs(spark, rows)).collect()) == order(w[:4] for w in want)
    # ids of one document count once: four documents are too few
    few = [(1, z, "a"), (1, z + " ", "a"), (2, z, "a"), (3, z, "a"), (None, z, "a")]
    assert {r["n_dropped"] for r in shared_lines.digests(docs(spark, few)).collect()} == {0}
    assert shared_lines.digests(docs(spark, [])).collect() == []
    long = "\n".join(f"{'k' * 40}{i % 1000}" for i in range(60_000))
    many = [(i, long, "a") for i in range(5)]
    assert order((r["doc_id"], r["n_lines"], r["n_dropped"]) for r in shared_lines.digests(docs(spark, many)).collect()) == [
        (i, 60_000, 60_000 if i < 4 else 0) for i in range(5)]


def phrase_rows(seed=2, n=150):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdEFGéñ") for _ in range(rng.randint(1, 4))) for _ in range(40)]
    fixed = [["New", "York", "city"], ["hot", "dog"], ["x", "x", "x"], ["ad", "hoc", "team"]]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(rng.randint(0, 60)):
            part = rng.choice(fixed) if rng.random() < 0.2 else [rng.choice(vocabulary)]
            text += " ".join(part) + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\r\n"])
        rows.append((i, text, rng.choice(["en", "en", "en", "de", None, "und"])))
    return [*rows, (900, None, "en"), (901, "", "fr"), (902, " . ,\n", "fr"), (903, "one", "it")]


def expected_phrases(rows, limit, least=10, inside=50):
    grams, sizes = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(w)
            for k in (1, 2, 3):
                grams[lang].update(tuple(w[i: i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in grams.items():
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            cuts = [(1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            longer = [c for q, c in f.items() if len(q) == 3 and c >= least and len(p) == 2 and p in (q[:2], q[1:])]
            if not any(100 * c >= inside * a for c in longer):
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(found)[:limit], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -s))
    return sorted(out)


def lang_docs(spark, rows):
    df = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], DOCS)
    for name in ("w1", "w2", "id", "a", "word", "n", "score"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.mark.parametrize("limit,first", [(2000, 2), (12, 1)])
def test_phrases_match_brute_force(spark, limit, first):
    rows = phrase_rows()
    want = expected_phrases(rows, limit)
    assert any(len(w[2].split()) == 3 for w in want) and len({w[0] for w in want}) >= 3
    got = phrases.collocations(lang_docs(spark, rows), limit=limit, first=first)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_phrase_edge_cases(spark):
    assert phrases.collocations(lang_docs(spark, [])).collect() == []
    assert phrases.collocations(lang_docs(spark, [(1, None, None), (2, "a b c", "en")])).collect() == []
    # ties at the last place are told apart by the phrase's bytes
    rows = [(i, " . ".join(f"{c}1 {c}2" for c in "zéab"), "en") for i in range(10)]
    got = phrases.collocations(lang_docs(spark, rows), limit=3)
    assert sorted(tuple(r) for r in got.collect()) == expected_phrases(rows, 3)


def test_phrases_of_long_texts_and_full_tallies(monkeypatch):
    """A long text read in stretches has the words of a text read whole; so do tallies handed on early."""
    rng = random.Random(8)
    text = "".join(rng.choice(["ab", "c", "é", " ", " ", ". ", "\n"]) for _ in range(4000)) + "w" * 900 + " end."
    data = np.frombuffer(text.encode(), np.uint8)
    bounds = np.asarray([0, len(data)])
    ids, begin, end, piece = phrases._words(data, bounds)
    monkeypatch.setattr(phrases, "STRETCH", 64)
    again = phrases._words(data, bounds)
    assert [x.tolist() for x in again] == [x.tolist() for x in (ids, begin, end, piece)]
    monkeypatch.setattr(phrases, "PENDING", 10)
    monkeypatch.setattr(phrases, "KEEP", 4)
    tally, out = phrases._Tally(["w1"]), Counter()
    batches = [b for k in range(0, len(ids), 7) for b in tally.add([ids[k: k + 7]])] + list(tally.rest())
    for b in batches:
        out.update(dict(zip(b.column(0).to_numpy().view(np.uint64).tolist(), b.column(1).to_pylist())) if len(set(b.column(0).to_pylist())) == len(b) else {})
    assert out == Counter(ids.tolist())


def test_a_tally_of_distinct_phrases_stays_small():
    rng, size = np.random.default_rng(1), 1 << 16
    tally, rows = phrases._Tally(["w1", "w2", "w3"]), 0
    tracemalloc.start()
    for _ in range(64):
        rows += sum(b.num_rows for b in tally.add([rng.integers(0, 1 << 63, size, np.uint64) for _ in range(3)]))
    rows += sum(b.num_rows for b in tally.rest())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 64 * size
    # three tasks of an executor with 3,000 MB have some 200 MB each beside the JVM and the libraries
    assert peak < 150 << 20, peak


def test_scores_are_exact_beyond_64_bits(spark):
    cases = [(10**15 + 7, 10**15 + 9, 10**15 + 11), (10, 10, 10), (3 * 10**12, 4 * 10**12 + 1, 5 * 10**12)]
    df = spark.createDataFrame(cases, "a bigint, l bigint, r bigint")
    got = [r[0] for r in df.select(phrases._score("a", "l", "r")).collect()]
    assert got == [1_000_000 * a * a // (left * right) for a, left, right in cases]


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    return df.withColumn("x", F.lit("clash")).withColumn("key", F.lit("clash")).withColumn("n", F.lit(0))


def expected_whitening(rows, d):
    finite = lambda v: v is not None and all(c is not None and np.isfinite(c) for c in v) and len(v) == d
    x = {i: tuple(int(np.floor(256.0 * float(np.float32(c)))) for c in v) for i, v in rows if finite(v)}
    listed = np.asarray(sorted(set(x.values())), dtype=object)
    n, s = len(listed), listed.sum(axis=0)
    y = n * listed - s
    v = np.asarray([[float(Fraction(int((y[:, i] * y[:, j]).sum()), n**3)) for j in range(d)] for i in range(d)])
    return x, n, s, v


def test_whitening_matches_the_covariance(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) * 3 + 5
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)] + [(0, rows[3][1])]  # copies, and rows that share an id
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2003, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (2004, []), (2005, [1.0])]
    x, n, s, v = expected_whitening([r for r in rows if r[0] != 0] + [rows[0]], 6)
    got = defaultdict(dict)
    count = 0
    for r in whitening.whiten(vectors(spark, rows)).collect():
        count += 1
        assert r["n"] == n == 300 and abs(r["identity_error"]) < 1e-9
        if r["vec_id"] != 0:
            assert r["deviation"] == sum((n * c - t) ** 2 for c, t in zip(x[r["vec_id"]], s, strict=True))
            got[r["vec_id"]][r["component"]] = (r["whitened"], r["explained"])
    assert count == 4 * 501 and set(got) == set(x) - {0}
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    z = np.asarray([[float(Fraction(int(c) * n - int(t), n)) for c, t in zip(x[i], s, strict=True)] for i in sorted(got)])
    for k in range(4):
        mine = np.asarray([got[i][k + 1][0] for i in sorted(got)])
        other = z @ u[:, k] / np.sqrt(e[k])
        assert min(np.abs(mine - other).max(), np.abs(mine + other).max()) < 1e-8
        assert abs(got[1][k + 1][1] - e[k] / np.trace(v)) < 1e-12


def test_whitening_edge_cases(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    # two dimensions, one without variance: one component
    got = whitening.whiten(vectors(spark, [(1, [1.0, 7.0]), (2, [2.0, 7.0]), (None, [4.0, 7.0])])).collect()
    assert [r["component"] for r in got] == [1, 1, 1] and abs(got[0]["explained"] - 1) < 1e-12 and None in {r["vec_id"] for r in got}
    # far from zero and beyond the narrow sums: still exact
    far = [(i, [float(2 ** 40 + i * 2 ** 18), float(i * i)]) for i in range(8)]
    x, n, s, _ = expected_whitening(far, 2)
    for r in whitening.whiten(vectors(spark, far)).collect():
        assert r["deviation"] == sum((n * c - int(t)) ** 2 for c, t in zip(x[r["vec_id"]], s, strict=True))
        assert r["identity_error"] < 1e-9


def test_polarised_sums_equal_products(monkeypatch):
    rng = np.random.default_rng(1)
    for scale in (5, 1 << 40):
        x = rng.integers(-scale, scale, size=(50, 4))
        s = whitening._column_sums(x)
        floor = [t // 50 for t in s]
        v = whitening.covariance(50, [t - 50 * f for t, f in zip(s, floor, strict=True)], whitening._squares(floor)(x))
        y = 50 * x.astype(object) - np.asarray(s, object)
        assert all(v[i][j] == Fraction(int((y[:, i] * y[:, j]).sum()), 50**3) for i in range(4) for j in range(4))


def test_texts_just_below_the_limit_make_few_pairs(spark, monkeypatch):
    """500 texts, each with edits of its own, a little below the limit to their original and further
    from each other: nobody is paired; two families among them are found whole."""
    rng = random.Random(12)
    base = [f"t{k}" for k in range(300)]

    def edited(words, n, tag):
        out = list(words)
        for at in rng.sample(range(2, 298), n):
            out[at] = f"{tag}{rng.randrange(40)}"
        return " ".join(out)

    rows = [(0, " ".join(base), "a")] + [(1 + i, edited(base, 6, "e"), "a") for i in range(500)]
    second = edited(base, 12, "s").split(" ")
    rows += [(1000 + i, edited(second, 1, "q"), "a") for i in range(30)]
    seen, ok = {}, near_duplicates.kept

    def counted(df, purpose):
        out = ok(df, purpose)
        if purpose in ("outside", "met", "pairs"):
            seen[purpose] = out.count()
        return out

    monkeypatch.setattr(near_duplicates, "kept", counted)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.components(docs(spark, rows), 85).collect()}
    sets = {}
    for i, text, _ in rows:
        w = text.split(" ")
        sets[i] = frozenset(tuple(w[k: k + 5]) for k in range(len(w) - 4))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert got == {i: find(i) for i in ids}
    # 140,000 pairs share tables; a few are met by residue, and each member once by each further centre
    assert seen["pairs"] < len(rows) and seen["met"] <= near_duplicates.FURTHER_CENTRES * seen["outside"]


def test_only_shared_residue_shingles_are_ranked(spark):
    rng = random.Random(8)
    # each member lacks some of the centre's shingles and has more of its own
    members = {a: {rng.randrange(12) for _ in range(4)} | {1000 * a + k for k in range(rng.randint(1, 30))} for a in range(1, 60)}
    rows = [(a, b, x) for a, held in members.items() for b in (0, a % 2) for x in held]
    rows = sorted(set(rows))
    f = Counter((b, x) for _, b, x in rows)
    got = near_duplicates._ranked_residues(spark.createDataFrame(rows, "a bigint, b bigint, shingle bigint")).collect()
    assert {(r.a, r.b, r.shingle) for r in got} == {(a, b, x) for a, b, x in rows if f[b, x] > 1} and len(got) < len(rows) / 2
    for r in got:
        # its place among all of the member's residue, rarest first
        every = sorted((f[b, x], x) for a, b, x in rows if (a, b) == (r.a, r.b))
        assert len(every) - r.common + r["rank"] == every.index((f[r.b, r.shingle], r.shingle)) + 1


def test_residues_list_only_what_other_members_may_share():
    held = lambda *x: np.sort(np.asarray(x, np.uint64)).tobytes()
    batch = pa.RecordBatch.from_pydict({
        "a": [5, 6], "b": [9, 9], "prefix": [5, 4], "own_a": [[10], None], "own_b": [[21, 20], [21, 20]],
        "set_a": [held(1, 2, 3, 10, 11), held(1, 2, 3, 4)], "set_b": [held(1, 2, 3, 4, 20, 21, 22)] * 2})
    got = pa.Table.from_batches(near_duplicates._residues(iter([batch]))).to_pylist()
    rows = {(r["a"], r["shingle"]): (r["place"], r["late"]) for r in got}
    # 5 differs by 10 (its own), 4, 11, 22, then 20 and 21 (the centre's own), of which the prefix reaches one
    assert rows == {(5, 4): (4, False), (5, 11): (4, False), (5, 22): (4, False), (5, 20): (5, True),
                    (6, 22): (1, False), (6, 20): (2, True), (6, 21): (3, True)} and len(got) == len(rows)
