"""License scan: TF-IDF cosine to templates, then inheritance from the nearest directory.

Every line of every text that names a licence is a header line.  Equal header lines are
counted first, so a line that a third of all files share is weighed once.  Lines and
templates are sparse TF-IDF vectors over their words, 1 + ln tf times ln((templates + 1) /
(templates with the word + 1)).  Frequencies are those of the templates, so a line has the
same licence in a collection of any size; a word of no template weighs most.  A line's
licence is the template of highest cosine, 0.5 at least, and a file's own licence is that
of its best line.  Lines that only reserve rights count where no line grants a licence.
Adjoining header lines are also one vector together, because notices are wrapped.

A file named as a licence is also compared as a whole, with the texts in ``license_texts``:
it has the licence of the likest text, 0.6 at least, whatever its single lines say.

The expression after ``SPDX-License-Identifier:`` names the licence itself (cosine 1.0),
without ``-only``, ``-or-later`` and ``+``; names without a template stand as they are.

A licence file covers its directory and all below.  A file without a header of its own
inherits from the nearest directory above it that has a licence: the distinct directories
are joined by path to their ancestors, then files to directories.  DataFrame functions only.

Defined cases: a null text has no header; a null path is a file in the root; ties between
templates go to the template listed first, ties between lines to the higher cosine and then
the template listed first; several licence files of one directory: likewise; a file with no
header and no covering directory has a null licence; repeated rows stay; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm.common import kept

# Wordings of the notices that the licences ask for, several a licence.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD style license"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0 Creative Commons Attribution NonCommercial"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0 Creative Commons Attribution ShareAlike"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, version 2.0"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("GPL-3.0", "GNU General Public License v3.0"),
    ("LGPL-3.0", "GNU Lesser General Public License v3.0"),
    ("MIT", "MIT License"),
    ("MIT", "Licensed under the MIT license"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Proprietary", "All rights reserved"),
    ("Proprietary", "Copyright (c) All rights reserved"),
]
#: Reserves rights and grants none: such a file inherits nothing.
RESERVED = "Proprietary"
#: Whole licence texts by the name of their file.
TEXTS = Path(__file__).resolve().parent / "license_texts"
#: A header line holds one of these word stems.
HEADER = "(?i)licen[cs]e|copyright|spdx|all rights reserved"
LEAST_COSINE = 0.5
LEAST_TEXT_COSINE = 0.6
#: An identifier or an expression of several; comment ends are left out.
SPDX = "(?i)SPDX-License-Identifier:\\s*([A-Za-z0-9(][A-Za-z0-9.+() -]*[A-Za-z0-9+)])"
SPDX_SUFFIX = "(?i)(-only|-or-later|[+])(?![A-Za-z0-9.-])"
LICENSE_FILE = "(?i)^(license|licence|copying)([.].*)?$"


def terms(line: Column) -> Column:
    """Lower-case words; dots and hyphens count as letters inside a word."""
    return F.filter(F.split(F.lower(line), "[^a-z0-9.-]+"), lambda t: F.regexp_replace(t, "^[.-]+|[.-]+$", "") != "")


def trimmed(words: Column) -> Column:
    return F.transform(words, lambda t: F.regexp_replace(t, "^[.-]+|[.-]+$", ""))


def words_of(text: str) -> list[str]:
    """``trimmed(terms(...))`` of a template."""
    return [t for t in (w.strip(".-") for w in re.split("[^a-z0-9.-]+", text.lower())) if t]


def term_weights(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """``term, idf, t0, t1, ...``: a term's weight in each template's vector of length one."""
    counts = [Counter(words_of(text)) for _, text in templates]
    df = Counter(term for c in counts for term in c)
    idf = {term: math.log((len(templates) + 1) / (n + 1)) for term, n in df.items()}
    vectors = [{term: (1 + math.log(n)) * idf[term] for term, n in c.items()} for c in counts]
    norms = [math.sqrt(sum(w * w for w in v.values())) for v in vectors]
    rows = [(term, idf[term], *(v.get(term, 0.0) / norm for v, norm in zip(vectors, norms, strict=True))) for term in sorted(df)]
    columns = "".join(f", t{i} double" for i in range(len(templates)))
    return spark.createDataFrame(rows, f"term string, idf double{columns}")


def best_template(tf: DataFrame, key: str, templates: list[tuple[str, str]], least: float) -> DataFrame:
    """``key, order, license, cosine`` of each key that is like a template; ``tf`` has ``key, term, tf``."""
    known = F.broadcast(term_weights(tf.sparkSession, templates))
    unknown = math.log(len(templates) + 1)
    weighed = tf.join(known, "term", "left").withColumn("w", (F.log("tf") + 1) * F.coalesce("idf", F.lit(unknown)))
    sums = weighed.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), *(
        F.sum(F.col("w") * F.coalesce(f"t{i}", F.lit(0.0))).alias(f"dot{i}") for i in range(len(templates))))
    cosines = F.array(*(F.struct(F.round(F.col(f"dot{i}") / F.col("norm"), 9).alias("cosine"), F.lit(-i).alias("order"), F.lit(name).alias("license"))
                        for i, (name, _) in enumerate(templates)))
    best = sums.filter("norm > 0").select(key, F.array_max(cosines).alias("best")).filter(F.col("best.cosine") >= least)
    return best.select(key, "best.order", "best.license", "best.cosine")


def counted(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term, tf`` of the texts."""
    return df.select(key, F.explode(trimmed(terms(F.col(text)))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def spdx(line: Column) -> Column:
    """The licence that an SPDX header names, in the spelling of the templates; empty without one."""
    named = F.regexp_replace(F.regexp_extract(line, SPDX, 1), SPDX_SUFFIX, "")
    spelling = {name.lower(): name for name in sorted({name for name, _ in [*TEMPLATES, *license_texts()]})}
    known = F.create_map(*(F.lit(x) for pair in spelling.items() for x in pair))
    return F.coalesce(known[F.lower(named)], named)


def line_licenses(headers: DataFrame) -> DataFrame:
    """``line, order, license, cosine`` of each distinct header line that is like a template.

    ``headers`` has a column ``line``, a row per occurrence.
    """
    distinct = headers.select("line").distinct().withColumn("spdx", spdx(F.col("line")))
    named = distinct.filter("spdx <> ''").select("line", F.lit(1).alias("order"), F.col("spdx").alias("license"), F.lit(1.0).alias("cosine"))
    return best_template(counted(distinct.filter("spdx = ''"), "line", "line"), "line", TEMPLATES, LEAST_COSINE).unionByName(named)


def license_texts() -> list[tuple[str, str]]:
    return [(path.stem, path.read_text(encoding="utf-8")) for path in sorted(TEXTS.glob("*.txt"))]


def text_licenses(files: DataFrame) -> DataFrame:
    """``doc_id, path, dir, name, order, license, cosine`` of licence files that are like a whole text."""
    named = files.filter(F.col("name").rlike(LICENSE_FILE) & F.col("text").isNotNull()).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    distinct = named.select("digest", "text").dropDuplicates(["digest"])
    liked = best_template(counted(distinct, "digest", "text"), "digest", license_texts(), LEAST_TEXT_COSINE)
    return named.drop("text").join(liked, "digest").drop("digest")


def header_parts(text: Column) -> Column:
    """Each header line, and each run of two or more adjoining header lines as one part."""
    lines = F.split(text, "\n")
    is_header = lambda x: x.rlike(HEADER)
    # other lines become NUL, so that runs lie between them
    runs = F.split(F.array_join(F.transform(lines, lambda x: F.when(is_header(x), F.translate(x, "\0", " ")).otherwise(F.lit("\0"))), "\n"), "\0")
    runs = F.filter(F.transform(runs, lambda x: F.regexp_replace(x, "^\n|\n$", "")), lambda x: x.contains("\n"))
    return F.when(text.rlike(HEADER), F.concat(F.filter(lines, is_header), runs))


def directory(path: Column) -> Column:
    """Everything up to the last slash, ``/`` for a file in the root."""
    return F.coalesce(F.when(F.regexp_extract(path, "^(.*)/", 1) == "", F.lit("/")).otherwise(F.regexp_extract(path, "^(.*)/", 1)), F.lit("/"))


def ancestors(folder: Column) -> Column:
    """``depth, above`` of the directory itself and of each directory above it."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda d: F.struct(
        d.alias("depth"), F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), d), "/")).alias("above")))


def scan(files: DataFrame) -> DataFrame:
    """Own, inherited and resulting licence of every file (``doc_id, path, text``)."""
    files = files.select("doc_id", "path", "text").withColumns({"dir": directory(F.col("path")), "name": F.regexp_extract(F.coalesce("path", F.lit("")), "[^/]*$", 0)})
    lines = files.select("doc_id", "path", "dir", "name", F.explode(header_parts(F.col("text"))).alias("line"))
    lines = kept(lines, "headers")
    liked = line_licenses(lines)
    headers = lines.join(liked, "line").withColumn("rank", F.when(F.col("license") == RESERVED, 0).otherwise(1)).drop("line").unionByName(
        text_licenses(files).withColumn("rank", F.lit(2)))
    best = F.max(F.struct("rank", "cosine", "order", "license"))
    own = headers.groupBy("doc_id", "path").agg(best.alias("own"))
    covers = headers.filter(F.col("name").rlike(LICENSE_FILE)).groupBy("dir").agg(best.alias("cover"))
    dirs = files.select("dir").distinct()
    above = dirs.select("dir", F.explode(ancestors(F.col("dir"))).alias("a")).select("dir", "a.depth", "a.above")
    nearest = above.join(covers.select(F.col("dir").alias("above"), "cover.license"), "above").groupBy("dir").agg(
        F.max(F.struct("depth", "above", "license")).alias("near"))
    out = files.select("doc_id", "path", "dir").join(own.withColumnsRenamed({"doc_id": "_id", "path": "_path"}),
        F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("path").eqNullSafe(F.col("_path")), "left").join(nearest, "dir", "left")
    return out.select(
        "doc_id", "path", F.col("own.license").alias("own_license"), F.col("own.cosine").alias("own_cosine"),
        F.col("near.license").alias("inherited_license"), F.col("near.above").alias("inherited_from"),
        F.coalesce("own.license", "near.license").alias("license"))
