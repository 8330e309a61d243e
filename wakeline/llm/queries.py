"""The registered queries of the subpackage and, where SQL can say it, their reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm import (
    licenses,
    line_frequency,
    near_duplicates,
    order_minhash,
    packing,
    passages,
    perspectives,
    phrases,
    schedule,
    shared_lines,
    token_counts,
    url_filter,
    whitening,
)
from wakeline.llm.common import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_perspective_rotation", """
WITH said AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM said WHERE role <> 'system'),
views AS (SELECT m.*, s.speaker,
  CASE WHEN role = 'system' THEN 'system' WHEN role = speaker THEN 'assistant' ELSE 'user' END AS chat_role,
  '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = speaker THEN 'assistant'
    ELSE 'user name=' || role END || chr(10) AS head
  FROM said m JOIN speakers s ON m.conv_id IS NOT DISTINCT FROM s.conv_id),
told AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS rendered FROM views),
placed AS (SELECT *, CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, speaker
    ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM told)
SELECT conv_id, speaker, turn, role, chat_role, rendered, start, start + length(rendered) AS "end",
  CASE WHEN chat_role = 'assistant' THEN start + length(head) ELSE start END AS mask_from,
  CASE WHEN chat_role = 'assistant' THEN start + length(rendered) - 1 ELSE start END AS mask_to
FROM placed""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate(table(spark, sf_dir, "conversations"))


@query("op2_order_minhash")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.compare_edited(table(spark, sf_dir, "documents"))


_WORDS = "list_filter(string_split_regex(coalesce({}, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


@query("op4_line_frequency", f"""
WITH docs AS (SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS text, {_WORDS.format('text')} AS ws FROM documents),
wins AS (SELECT doc_id, i, len(ws) AS n, array_to_string(ws[i:i+4], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM docs WHERE len(ws) >= 5)),
twice AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM wins) WHERE c >= 2),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY 1),
lines AS (SELECT doc_id, host, line, text,
    trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS norm,
    len({_WORDS.format('line')}) AS nw
  FROM (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup FROM lines GROUP BY 1),
hosts AS (SELECT host, greatest(10, 0.10::DOUBLE * count(DISTINCT text)) AS lim FROM docs GROUP BY 1),
hot AS (SELECT host, norm FROM lines JOIN hosts USING (host) GROUP BY host, norm, lim HAVING count(DISTINCT text) > lim),
lost AS (SELECT doc_id, CAST(sum(nw) AS BIGINT) AS n_lost FROM lines JOIN hot USING (host, norm) GROUP BY 1),
base AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words,
    coalesce(n_lost, 0) AS n_removed_words
  FROM docs d LEFT JOIN covered USING (doc_id) LEFT JOIN dups USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (n_words - n_removed_words < n_words * 0.5) AS kept
FROM base""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.verdicts(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept")


URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


@query("op8_blocked_bloom_urls", r"""
WITH cut AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, url, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') AS path FROM cut),
ruled AS (SELECT *, CASE WHEN host = '' THEN '' ELSE regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') END AS canonical,
  CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM hosts),
listed AS (SELECT DISTINCT canonical FROM ruled JOIN labels
  ON try_cast(regexp_extract(url, '/[a-z][a-z]/([0-9]+)', 1) AS BIGINT) = doc_id AND toxic = 1 WHERE canonical <> '')
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM ruled r LEFT JOIN listed l ON r.canonical = l.canonical""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed are the canonical URLs of pages whose document is labelled toxic."""
    pages = table(spark, sf_dir, "pages")
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    host, path = url_filter.host_and_path(F.col("url"))
    number = F.regexp_extract("url", "/[a-z][a-z]/([0-9]+)", 1).try_cast("bigint")
    listing = pages.select(number.alias("doc_id"), url_filter.canonical(host, path).alias("canonical")).join(toxic, "doc_id")
    return url_filter.judge(pages, listing, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op5_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@query("op7_golden_ratio_mix", """
WITH docs AS (SELECT doc_id, coalesce('0' || source, '1') AS queue, md5(CAST(doc_id AS VARCHAR)) AS deal,
    CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size FROM documents),
s0 AS (SELECT queue, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY 1),
s1 AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY queue) - 1) % 3] AS w,
    1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS wanted FROM s0),
s2 AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS ratio FROM s1),
s3 AS (SELECT *, (wanted - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS lvl FROM s2
  WINDOW o AS (ORDER BY ratio, queue ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, least(cap, w * coalesce((SELECT lvl FROM s3 WHERE lvl <= ratio ORDER BY ratio, queue LIMIT 1), 0)) AS target FROM s3),
s5 AS (SELECT *, CAST(round(target) AS BIGINT) AS words, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS passes FROM s4),
laid AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY queue ORDER BY deal, doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM docs)
SELECT doc_id, size, source_size, target,
  CAST(passes * size + greatest(0, least(size, words - passes * source_size - start)) AS BIGINT) AS taken
FROM laid JOIN s5 USING (queue)""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.mix(table(spark, sf_dir, "documents"))


@query("op3_deficit_round_robin_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


_SHORT = "regexp_replace({}, '^[.-]+|[.-]+$', '', 'g')"
_TERMS = ("list_filter(list_transform(string_split_regex(lower(line), '[^a-z0-9.-]+'), lambda t: " + _SHORT.format("t")
          + "), lambda t: t <> '')")
_TEMPLATE_VALUES = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(licenses.TEMPLATES))


@query("op10_license_scan", f"""
WITH files AS (SELECT doc_id, text, coalesce(source, 'none') AS src, coalesce(lang, 'none') AS lg, doc_id % 16 = 0 AS is_licence,
    (doc_id // 16) % 3 AS lvl, CAST((doc_id // 64) % 8 AS VARCHAR) AS shard FROM documents),
placed AS (SELECT doc_id, text, is_licence, CASE WHEN is_licence AND lvl = 0 THEN '/' || src WHEN is_licence AND lvl = 1 THEN '/' || src || '/' || lg
    ELSE '/' || src || '/' || lg || '/' || shard END AS dir FROM files),
paths AS (SELECT *, dir || CASE WHEN is_licence THEN '/LICENSE' ELSE '/' || CAST(doc_id AS VARCHAR) || '.txt' END AS path FROM placed),
lines AS (SELECT doc_id, path, dir, is_licence, line FROM (SELECT *, unnest(string_split(text, chr(10))) AS line FROM paths)
  WHERE regexp_matches(line, '{licenses.HEADER}')),
uniq AS (SELECT line, count(*) AS n FROM lines GROUP BY 1),
tot AS (SELECT CAST(coalesce(sum(n), 0) AS DOUBLE) AS lines FROM uniq),
tf AS (SELECT line, n, term, count(*) AS tf FROM (SELECT line, n, unnest({_TERMS}) AS term FROM uniq) GROUP BY 1, 2, 3),
df AS (SELECT term, CAST(sum(n) AS DOUBLE) AS df FROM tf GROUP BY 1),
tmpl AS (SELECT * FROM (VALUES {_TEMPLATE_VALUES}) v(place, license, line)),
ttf AS (SELECT place, license, term, count(*) AS tf FROM (SELECT place, license, unnest({_TERMS}) AS term FROM tmpl) GROUP BY 1, 2, 3),
ours AS (SELECT line, term, tf * (ln((lines + 1) / (coalesce(df, 0) + 1)) + 1) AS w FROM tf LEFT JOIN df USING (term), tot),
theirs AS (SELECT place, license, term, tf * (ln((lines + 1) / (coalesce(df, 0) + 1)) + 1) AS w FROM ttf LEFT JOIN df USING (term), tot),
cos AS (SELECT o.line, place, license, round(sum(o.w * t.w) / (any_value(n1) * any_value(n2)), 9) AS cosine
  FROM ours o JOIN theirs t USING (term) JOIN (SELECT line, sqrt(sum(w * w)) AS n1 FROM ours GROUP BY 1) a ON a.line = o.line
  JOIN (SELECT place, sqrt(sum(w * w)) AS n2 FROM theirs GROUP BY 1) b USING (place) GROUP BY 1, 2, 3),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY cosine DESC, place) AS k FROM cos WHERE cosine >= 0.5) WHERE k = 1),
heads AS (SELECT l.*, b.place, b.license, b.cosine FROM lines l JOIN best b USING (line)),
own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, place) AS r FROM heads) WHERE r = 1),
covers AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, place) AS r FROM heads WHERE is_licence) WHERE r = 1),
near AS (SELECT * FROM (SELECT p.doc_id, c.license, c.dir AS above, row_number() OVER (PARTITION BY p.doc_id ORDER BY length(c.dir) DESC) AS r
  FROM paths p JOIN covers c ON p.dir = c.dir OR starts_with(p.dir, c.dir || '/')) WHERE r = 1)
SELECT p.doc_id, p.path, o.license AS own_license, o.cosine AS own_cosine, n.license AS inherited_license, n.above AS inherited_from,
  coalesce(o.license, n.license) AS license
FROM paths p LEFT JOIN own o USING (doc_id) LEFT JOIN near n USING (doc_id)""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: /source/lang/shard/id.txt; every sixteenth is a LICENSE file of one
    of the three levels in turn."""
    docs = table(spark, sf_dir, "documents")
    source, lang = F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none"))
    number = F.floor(F.col("doc_id") / 16)
    shard = F.pmod(F.floor(F.col("doc_id") / 64), F.lit(8)).cast("string")
    is_licence = F.pmod("doc_id", F.lit(16)) == 0
    level = F.pmod(number, F.lit(3))
    full = F.concat_ws("/", F.lit(""), source, lang, shard)
    folder = F.when(is_licence & (level == 0), F.concat_ws("/", F.lit(""), source)).when(
        is_licence & (level == 1), F.concat_ws("/", F.lit(""), source, lang)).otherwise(full)
    path = F.concat(folder, F.when(is_licence, F.lit("/LICENSE")).otherwise(F.concat(F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))))
    return licenses.scan(docs.select("doc_id", path.alias("path"), "text"))


@query("op6_column_suffix_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.digests(table(spark, sf_dir, "documents"))


@query("op9_tensored_minhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.components(table(spark, sf_dir, "documents"), threshold=85)


_STRIPPED = "translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op11_shared_lines", f"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM docs),
keyed AS (SELECT *, {_STRIPPED} AS key FROM lines),
frequent AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
told AS (SELECT k.*, f.key IS NOT NULL AND doc_id < keeper AS lost FROM keyed k LEFT JOIN frequent f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM told GROUP BY doc_id""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_lines.digests(table(spark, sf_dir, "documents"))


def _phrase_sql(limit: int) -> str:
    cut = "1000000::HUGEINT * a * a // (CAST({} AS HUGEINT) * {})".format
    return f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
ws AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
one AS (SELECT lang, x, count(*) AS f FROM (SELECT lang, unnest(w) AS x FROM ws) GROUP BY ALL),
sizes AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM one GROUP BY 1),
two AS (SELECT lang, p.x, p.y, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: {{'x': w[i], 'y': w[i + 1]}})) AS p FROM ws) GROUP BY ALL HAVING f >= 10),
three AS (SELECT lang, p.x, p.y, p.z, count(*) AS a FROM (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: {{'x': w[i], 'y': w[i + 1], 'z': w[i + 2]}})) AS p FROM ws) GROUP BY ALL HAVING a >= 10),
pair AS (SELECT t.lang, t.x || ' ' || t.y AS phrase, t.f AS a, u.f AS l, v.f AS r FROM two t
  JOIN one u ON u.lang = t.lang AND u.x = t.x JOIN one v ON v.lang = t.lang AND v.x = t.y
  WHERE NOT EXISTS (SELECT 1 FROM three h WHERE h.lang = t.lang AND 100 * h.a >= 50 * t.f AND (h.x = t.x AND h.y = t.y OR h.y = t.x AND h.z = t.y))),
cuts AS (SELECT h.lang, h.x || ' ' || h.y || ' ' || h.z AS phrase, a, u.f AS l1, yz.f AS r1, xy.f AS l2, v.f AS r2 FROM three h
  JOIN one u ON u.lang = h.lang AND u.x = h.x JOIN one v ON v.lang = h.lang AND v.x = h.z
  JOIN two xy ON xy.lang = h.lang AND xy.x = h.x AND xy.y = h.y JOIN two yz ON yz.lang = h.lang AND yz.x = h.y AND yz.y = h.z),
scored AS (SELECT lang, phrase, a, l, r, {cut('l', 'r')} AS score FROM pair UNION ALL
  SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2)
  FROM (SELECT *, {cut('l1', 'r1')} AS s1, {cut('l2', 'r2')} AS s2 FROM cuts)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN sizes USING (lang) WHERE rank <= {limit}"""


@query("op12_phrase_collocations", _phrase_sql(phrases.LIMIT))
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query("op13_polarised_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
