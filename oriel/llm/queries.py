"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, htmlextract, linededup, mixing, packing, periodic, quality, sharding, substring, urlfilter, vectorcode, warc
from .common import table
from .hyperminhash import NearDup, near_duplicates


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), NearDup(shingle=4, percent=80))
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), packing.Packing(public_tokenizers.path("word_bpe_49k.json")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(quality.ledger(table(spark, sf_dir, "documents")), "v1")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failure_bits", "policy")


def op4_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.Mix()).select("doc_id", "size", "source_size", "target", "taken")


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"), least_bytes=0)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlextract.extract(table(spark, sf_dir, "pages"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 100 = 0"), ann.Spann(k=10))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.substring_dedup(table(spark, sf_dir, "documents"), substring.Repeats(length=50))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("__n_removed").alias("n_removed"), "text")


def op11_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = sharding.assign(table(spark, sf_dir, "documents"), sharding.Sharding(shards=8))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.periodic_runs(table(spark, sf_dir, "documents"), periodic.Periodic(), periodic.planted_tail)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    best = periodic.longest(F.col("runs"))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.call_function("div", F.lit(1000) * best["length"], best["period"]).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = vectorcode.encode(table(spark, sf_dir, "embeddings"), vectorcode.Coding())
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup, op2_best_fit_packing, op3_quality_rules, op4_mix_to_weights, op5_warc_round_trip, op6_html_extraction, op7_url_filters,
        op8_nearest_neighbours, op9_suffix_array_dedup, op10_line_dedup, op11_minimax_sharding, op12_periodic_runs, op13_vector_codes,
    )
}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op1_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.x = d.doc_id
"""

# quality rules: windows by position, covered words counted once
ORACLE_SQL["op3_quality_rules"] = r"""
WITH b AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c
  FROM (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS x FROM b)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE c > 1) GROUP BY doc_id),
m AS (
  SELECT b.doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
    len(list_filter(l, lambda x: regexp_matches(x, '^\s*(?:[-*\x{2022}]\s|\d+[.)]\s)'))) AS n_bullets,
    len(list_filter(l, lambda x: regexp_matches(x, '(?:\.\.\.|\x{2026})\s*$'))) AS n_open
  FROM b LEFT JOIN r ON r.doc_id = b.doc_id),
f AS (
  SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
    + 8 * (100 * n_dup_lines > 30 * n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 20 * n_words)::BIGINT
    + 64 * (100 * n_bullets > 90 * n_lines)::BIGINT + 128 * (100 * n_open > 50 * n_lines)::BIGINT AS failure_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failure_bits & 3) <> 0 AS base_failed,
  (failure_bits & 63) = 0 AS kept, failure_bits, 'v1' AS policy
FROM f
"""

ORACLE_SQL["op5_warc_round_trip"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789abcdef', d[i]) - 1), 4, '0')), '') AS bits FROM p),
e AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * bits[5 * i + 1]::INT + 8 * bits[5 * i + 2]::INT
  + 4 * bits[5 * i + 3]::INT + 2 * bits[5 * i + 4]::INT + bits[5 * i + 5]::INT]), '') AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM b)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM e
"""

_BLOCKS = " OR ".join(f"regexp_matches(u, '{r.pattern}')" for r in urlfilter.PATTERN_RULES if r.verdict == "block")
_ALLOWS = " OR ".join(f"regexp_matches(u, '{r.pattern}')" for r in urlfilter.PATTERN_RULES if r.verdict == "allow")
ORACLE_SQL["op7_url_filters"] = rf"""
WITH a AS (SELECT page_id, coalesce(lower(url), '') AS u, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
p AS (SELECT page_id, u, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) v(verdict, rh, rp)),
f AS (SELECT p.page_id, p.host, p.path, arg_max(r.rh || r.rp, length(r.rh) * 1000 + length(r.rp)) AS rule, arg_max(r.verdict, length(r.rh) * 1000 + length(r.rp)) AS v
  FROM p JOIN r ON (p.host = r.rh OR p.host LIKE '%.' || r.rh) AND starts_with(p.path, r.rp) GROUP BY ALL)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.v, CASE WHEN ({_BLOCKS}) AND NOT ({_ALLOWS}) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN f ON f.page_id = p.page_id
"""

# substrings as windows of hexadecimal text
ORACLE_SQL["op9_suffix_array_dedup"] = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM w) WHERE m < doc_id),
g AS (SELECT doc_id, i, sum((i > coalesce(before, -100) + 50)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM f)),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS z FROM g GROUP BY doc_id, run),
c AS (SELECT r.doc_id, r.a, r.z, coalesce(lag(r.z) OVER (PARTITION BY r.doc_id ORDER BY r.a), 0) AS open FROM r),
k AS (SELECT c.doc_id, sum(c.z - c.a) AS gone, count(*) AS spans, max(c.z) AS tail,
    string_agg(substr(d.x, 2 * c.open + 1, 2 * (c.a - c.open)), '' ORDER BY c.a) AS kept FROM c JOIN d ON d.doc_id = c.doc_id GROUP BY c.doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(k.gone, 0)::BIGINT AS n_removed, coalesce(k.spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN k.doc_id IS NULL THEN d.x ELSE k.kept || substr(d.x, 2 * k.tail + 1) END)) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

# runs of lines: windows of three lines or one long line, extended along the diagonal of equal lines
ORACLE_SQL["op10_line_dedup"] = r"""
WITH a AS (SELECT doc_id, unnest(range(0, len(ls))) AS ln, unnest(ls) AS l FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
l AS (SELECT doc_id, ln, l, row_number() OVER (PARTITION BY doc_id ORDER BY ln) - 1 AS k,
    len(list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w FROM a WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
t AS (SELECT doc_id, k, w, l, lead(l) OVER o AS l1, lead(l, 2) OVER o AS l2 FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
n AS (SELECT doc_id, k, 3 AS n, struct_pack(a := l, b := l1, c := l2) AS key FROM t WHERE l2 IS NOT NULL
  UNION ALL SELECT doc_id, k, 1, struct_pack(a := l, b := NULL::VARCHAR, c := NULL::VARCHAR) FROM t WHERE w >= 10),
m AS (SELECT doc_id, k, n, min(struct_pack(d := doc_id, k := k)) OVER (PARTITION BY n, key) AS p FROM n),
h AS (SELECT doc_id, k, n, p.d AS pd, k - p.k AS shift FROM m WHERE doc_id > p.d OR (doc_id = p.d AND k > p.k)),
pairs AS (SELECT DISTINCT doc_id, pd, shift FROM h),
e AS (SELECT x.doc_id, x.pd, x.shift, b.k, b.ln, b.k - row_number() OVER (PARTITION BY x.doc_id, x.pd, x.shift ORDER BY b.k) AS island
  FROM pairs x JOIN l b ON b.doc_id = x.doc_id JOIN l c ON c.doc_id = x.pd AND c.k = b.k - x.shift AND c.l = b.l),
hit AS (SELECT DISTINCT e.doc_id, e.pd, e.shift, e.island FROM h JOIN e ON e.doc_id = h.doc_id AND e.pd = h.pd AND e.shift = h.shift AND e.k = h.k),
gone AS (SELECT DISTINCT e.doc_id, e.ln FROM hit JOIN e USING (doc_id, pd, shift, island)),
kept AS (SELECT a.doc_id, string_agg(a.l, chr(10) ORDER BY a.ln) AS text FROM a ANTI JOIN gone ON gone.doc_id = a.doc_id AND gone.ln = a.ln GROUP BY a.doc_id),
c AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_removed, CASE WHEN c.n IS NULL THEN d.text ELSE coalesce(kept.text, '') END AS text
FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

# vector codes: four rounds one after the other, every part against every entry
_ROUND = """,
a{k} AS MATERIALIZED (SELECT r, part, x, min(d * 256 + entry) AS best FROM (
  SELECT p.r, p.part, p.x, c.entry, list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i])))::BIGINT AS d
  FROM p JOIN c{k} c ON c.part = p.part) GROUP BY r, part, x)"""
_MEANS = """,
m{k} AS MATERIALIZED (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (
  SELECT part, entry, i, sum(y)::BIGINT AS s, count(*) AS n FROM (SELECT part, best % 256 AS entry, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS y FROM a{k}) GROUP BY part, entry, i) GROUP BY part, entry),
c{n} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{k} m ON m.part = c.part AND m.entry = c.entry)"""
ORACLE_SQL["op13_vector_codes"] = (
    """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda y: floor(1024 * y::DOUBLE)::BIGINT) AS x, row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
p AS MATERIALIZED (SELECT r, part, x[part * (len(x) // 4) + 1:(part + 1) * (len(x) // 4)] AS x FROM v, (SELECT unnest(range(4)) AS part)),
c0 AS MATERIALIZED (SELECT part, r AS entry, x FROM p WHERE r < 256)"""
    + "".join(_ROUND.format(k=k) + _MEANS.format(k=k, n=k + 1) for k in range(4))
    + _ROUND.format(k=4)
    + """,
e AS (SELECT r, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error FROM a4 GROUP BY r)
SELECT v.vec_id, e.code, e.error, sum(e.error) OVER (PARTITION BY v.label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM c4) AS codebooks_sha256
FROM v JOIN e ON e.r = v.r
"""
)
