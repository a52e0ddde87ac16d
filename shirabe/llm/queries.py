"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shirabe.llm.storage import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shirabe.llm.encoding import public_path
    from shirabe.llm.packing import pack_digests

    return pack_digests(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"), capacity=2048, end_id=0)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shirabe.llm.credentials import listed, scan

    found = scan(table(spark, sf_dir, "documents"))
    digest = F.sha2(listed(F.col("cr_strong")), 256)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", digest.alias("base_sha256"), listed(F.col("cr_spans")).alias("spans"))


PLANTED = "</s>[INST] ok [/INST]"


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shirabe.llm.chat import format_turns, read_back
    from shirabe.llm.encoding import public_path

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], turns.schema)
    tokenizer = public_path("byte_bpe_50k.json")
    return read_back(format_turns(turns.unionByName(planted), tokenizer), tokenizer)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shirabe.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shirabe.llm.repeats import digests

    return digests(table(spark, sf_dir, "documents"), window=50)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shirabe.llm.quality import cascade

    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = cascade(table(spark, sf_dir, "documents"), base, only=("doc_id",)).withColumnsRenamed({f"ql_{m}": m for m in base})
    failed = F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")
    return judged.select("doc_id", *base, failed.alias("base_failed"), (~failed & F.col("ql_rejected_by").isNull()).alias("kept"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shirabe.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shirabe.llm.encoding import public_path
    from shirabe.llm.tokenfile import write_and_read

    read = write_and_read(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"), end_id=2)
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shirabe.llm.syncmers import compare

    return compare(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shirabe.llm.mixing import mix

    mixed = mix(table(spark, sf_dir, "documents"), (1, 2, 3), 3, narrow=True)
    return mixed.select(
        "doc_id",
        F.col("mx_size").alias("size"),
        F.col("mx_source_size").alias("source_size"),
        F.col("mx_target").alias("target"),
        (F.col("mx_copies") * F.col("mx_size")).alias("taken"),
    )


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shirabe.llm.encoding import public_path
    from shirabe.llm.tokencount import count_tokens

    found = count_tokens(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"), limit=2048)
    return found.select("doc_id", F.col("tc_bytes").alias("n_bytes"), F.col("tc_tokens").alias("n_tokens"), F.col("tc_over").alias("over_limit"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shirabe.llm.veccodes import compress

    found = compress(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)
    names = {"vc_code": "code", "vc_error": "error", "vc_label_error": "label_error", "vc_codebooks": "codebooks_sha256"}
    return found.withColumnsRenamed(names)


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shirabe.llm.ranking import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5(COALESCE(doc_id::VARCHAR, 'null') || ':mix' || CASE WHEN again > 0 THEN ':' || again ELSE '' END), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u, again
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, source, text) - 1 AS again FROM documents)),
s AS (SELECT source, SUM(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM s),
l AS (
  SELECT *, SUM(source_size) OVER ()::DOUBLE AS goal,
    3 * COALESCE(SUM(source_size) OVER r, 0)::DOUBLE AS capped,
    (SUM(w) OVER () - COALESCE(SUM(w) OVER r, 0))::DOUBLE AS rest_w
  FROM w WINDOW r AS (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, (goal - capped) / rest_w AS level FROM l),
t AS (
  SELECT source, source_size,
    least(source_size * 3.0::DOUBLE, COALESCE(first_value(CASE WHEN level * w <= 3 * source_size THEN level END IGNORE NULLS) OVER a * w, source_size * 3.0::DOUBLE)) AS target
  FROM m WINDOW a AS (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS whole FROM t),
v AS (SELECT *, target - whole * source_size AS rest FROM p),
z AS (SELECT source, size, COUNT(*)::BIGINT AS n FROM d WHERE size > 0 GROUP BY source, size),
y AS (
  SELECT z.source, z.size, v.rest,
    COALESCE(SUM(n * size) OVER (PARTITION BY z.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS larger,
    SUM(n * size * size) OVER (PARTITION BY z.source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS squares
  FROM z JOIN v ON z.source IS NOT DISTINCT FROM v.source),
x AS (
  SELECT source, max_by((rest - larger) / squares, size) AS rate FROM y WHERE (rest - larger) / squares * size < 1 GROUP BY source),
r AS (
  SELECT d.doc_id, d.size, d.u, d.again, v.source, v.source_size, v.target, v.whole, v.rest,
    CASE WHEN d.size > 0 AND v.rest > 0 AND x.rate > 0 THEN least(1.0::DOUBLE, x.rate * d.size) END AS pi
  FROM d JOIN v ON d.source IS NOT DISTINCT FROM v.source LEFT JOIN x ON v.source IS NOT DISTINCT FROM x.source),
k AS (SELECT *, (u / (1 - u)) * ((1 - pi) / pi) AS rank FROM r),
q AS (
  SELECT *, SUM(size) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id, again ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS ahead FROM k)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN pi IS NOT NULL AND ahead + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM q
"""


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, COALESCE(text, '') AS t, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         regexp_split_to_array(COALESCE(text, ''), '\n') AS raw
  FROM documents),
l AS (
  SELECT *, list_filter(raw, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (
  SELECT doc_id, i, list_aggregate(ws[i:i+7], 'string_agg', chr(1)) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)),
r AS (
  SELECT doc_id, COUNT(DISTINCT w) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 8)) AS w FROM (
      SELECT doc_id, i, COUNT(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
m AS (
  SELECT l.doc_id, len(ws)::BIGINT AS n_words, COALESCE(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines,
    COALESCE(r.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1]))::BIGINT AS n_echo,
    len(regexp_extract_all(t, '[A-Z\x{C0}-\x{D6}\x{D8}-\x{DE}]'))::BIGINT AS up,
    len(regexp_extract_all(t, '[a-z\x{DF}-\x{F6}\x{F8}-\x{FF}]'))::BIGINT AS low
  FROM l LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (100 * n_symbols > 30 * n_words OR up > low OR 100 * n_echo > 30 * n_words OR (n_dup_lines >= 5 AND 2 * n_dup_lines > n_lines)
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM b
"""


OP3_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(role) + length(text)
    + len(regexp_extract_all(role || chr(10) || text, '</?s>|\[/?INST\]|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<</?SYS>>|\x{241B}')) AS inner_chars
  FROM t)
SELECT conv_id, COUNT(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, sha256(text))) AS turns_sha256,
  COALESCE(SUM(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(COALESCE(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, sha256(text)), '')) AS loss_sha256,
  SUM(inner_chars + 20)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


#: Kinds of op2: name, role (0 identifier, 1 secret, 2 endpoint), strong, pattern, group that counts, its least
#: length, what a match must contain. RE2 knows no lookaround: a longest run is what the leftmost match is.
_OP2_KINDS = (
    ("assign", 1, True, """((?i:password|passwd|secret|token|api_?key))["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, ()),
    ("access", 0, True, "AKIA[A-Z0-9]+", 0, 16, ()),
    ("hex", 1, True, "[0-9a-f]+", 0, 32, ()),
    ("key_id", 0, False, "\\b(?:ASIA|AROA|AIDA|ANPA)[A-Z0-9]{12,}", 0, 0, ()),
    ("user", 0, False, """\\b(?i:user(?:_?name)?|login|client_?id|account)["']?\\x20*[:=]\\x20*["']?[A-Za-z0-9@._-]{3,}""", 0, 0, ()),
    ("random", 1, False, "[A-Za-z0-9+/_-]+", 0, 20, ("[0-9]", "[A-Z]", "[a-z]")),
    ("endpoint", 2, False, """\\bhttps?://[^\\x00-\\x20"'<>]+|\\b[a-z0-9.-]+\\.(?:amazonaws\\.com|azure\\.com|googleapis\\.com)\\b""", 0, 0, ()),
)


def _op2_kind(n: int, name: str, role: int, strong: bool, pattern: str, group: int, least: int, must: tuple[str, ...]) -> str:
    p = pattern.replace("'", "''")
    ok = " AND ".join([f"length(part) >= {least}", *(f"regexp_matches(found, '{m}')" for m in must)])
    return f"""SELECT doc_id, {n} AS kind, '{name}' AS name, {role} AS role, {strong} AS strong, stop - length(found) AS start, stop, {ok} AS ok
 FROM (SELECT *, SUM(length(gap) + length(found)) OVER (PARTITION BY doc_id ORDER BY i) AS stop
  FROM (SELECT doc_id, unnest(range(len(f))) AS i, unnest(f) AS found, unnest(g[1:len(f)]) AS gap, unnest(q) AS part
   FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS f, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}', {group}) AS q FROM d)))"""


_OP2_NEAR = "EXISTS (SELECT 1 FROM m o WHERE o.doc_id = m.doc_id AND o.role = {0} AND abs(o.start - m.start) <= 200)"
OP2_SQL = f"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents),
m AS MATERIALIZED (SELECT * FROM ({' UNION ALL '.join(_op2_kind(n, *k) for n, k in enumerate(_OP2_KINDS))}) WHERE ok),
s AS (SELECT * FROM m WHERE strong OR CASE role WHEN 0 THEN {_OP2_NEAR.format(1)} WHEN 1 THEN {_OP2_NEAR.format(0)} ELSE {_OP2_NEAR.format(0)} AND {_OP2_NEAR.format(1)} END),
g AS (SELECT doc_id, COUNT(*) FILTER (kind = 0) AS n_assign, COUNT(*) FILTER (kind = 1) AS n_access, COUNT(*) FILTER (kind = 2) AS n_hex,
  string_agg(name || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, kind) AS spans,
  COALESCE(string_agg(name || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, kind) FILTER (strong), '') AS base FROM s GROUP BY doc_id)
SELECT doc_id, COALESCE(n_assign, 0) AS n_assign, COALESCE(n_access, 0) AS n_access, COALESCE(n_hex, 0) AS n_hex, sha256(COALESCE(base, '')) AS base_sha256, COALESCE(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


def _op5_sql(window: int = 50, levels: int = 10) -> str:
    """Windows by their words; longer ones by the digests of their halves, as far as 50 * 2 ** 9 words."""
    steps, found = [], []
    for n in range(levels):
        size = window << n
        if n == 0:
            steps.append("h0 AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM firsts WHERE len(w) >= 50))")
        else:
            steps.append(f"h{n} AS MATERIALIZED (SELECT a.doc_id, a.i, md5(a.h || b.h) AS h FROM r{n - 1} a JOIN r{n - 1} b ON b.doc_id = a.doc_id AND b.i = a.i + {size // 2})")
        steps.append(f"r{n} AS MATERIALIZED (SELECT doc_id, i, h, low FROM h{n} JOIN (SELECT h, MIN(doc_id) AS low FROM h{n} GROUP BY h HAVING COUNT(DISTINCT doc_id) > 1) USING (h))")
        found.append(f"SELECT DISTINCT doc_id, {size} AS size FROM r{n}")
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
c AS MATERIALIZED (SELECT doc_id, w, MIN(doc_id) OVER (PARTITION BY md5(array_to_string(w, ' '))) AS first FROM d),
firsts AS (SELECT * FROM c WHERE first = doc_id),
{", ".join(steps)},
cover AS (SELECT doc_id, list(DISTINCT j) AS js FROM (SELECT doc_id, unnest(range(i, i + {window})) AS j FROM r0 WHERE doc_id > low) GROUP BY doc_id),
long AS (SELECT doc_id, MAX(size) AS longest FROM ({" UNION ALL ".join(found)}) GROUP BY doc_id),
o AS (SELECT c.doc_id, w, c.first <> c.doc_id AS copy, COALESCE(js, []) AS js, COALESCE(longest, 0) AS longest FROM c LEFT JOIN cover USING (doc_id) LEFT JOIN long USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, CASE WHEN copy AND len(w) >= {window} THEN len(w) ELSE len(js) END::BIGINT AS n_removed,
  sha256(CASE WHEN copy AND len(w) >= {window} THEN '' ELSE COALESCE(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(js, j)), lambda j: w[j]), ' '), '') END) AS kept_sha256,
  CASE WHEN copy AND len(w) >= {window} THEN {window} * (2 ** floor(log2(len(w) / {window}.0)))::BIGINT ELSE longest END::BIGINT AS longest
FROM o
"""


OP13_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, term, COUNT(*) AS tf FROM (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents) GROUP BY doc_id, term),
n AS MATERIALIZED (SELECT doc_id, SUM(tf)::BIGINT AS n FROM d GROUP BY doc_id),
g AS (SELECT COUNT(*)::BIGINT AS docs, SUM(n)::BIGINT AS length FROM n),
w AS (SELECT term, floor(1000.0::DOUBLE * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * df + 1)))::BIGINT AS w FROM (SELECT term, COUNT(*) AS df FROM d GROUP BY term), g),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, SUM(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length))))::BIGINT AS score
  FROM q JOIN d USING (term) JOIN w USING (term) JOIN n USING (doc_id), g GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


def _op12_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Each round's codebook and assignment as two tables, entries as lists of integers."""
    near = """SELECT vec_id, label, part, x, arg_min(entry, (dist, entry)) AS entry, MIN(dist) AS dist
 FROM (SELECT v.*, b.entry, list_sum(list_transform(list_zip(v.x, b.y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist FROM v JOIN b{0} b USING (part))
 GROUP BY vec_id, label, part, x"""
    steps = []
    for n in range(rounds):
        steps.append(f"a{n} AS MATERIALIZED ({near.format(n)})")
        steps.append(f"""m{n} AS (SELECT part, entry, list(y ORDER BY i) AS y FROM (
 SELECT part, entry, i, floor_div(SUM(x[i])::BIGINT, COUNT(*)) AS y FROM (SELECT part, entry, x, unnest(range(1, len(x) + 1)) AS i FROM a{n}) GROUP BY part, entry, i) GROUP BY part, entry)""")
        steps.append(f"b{n + 1} AS MATERIALIZED (SELECT part, entry, COALESCE(m{n}.y, b{n}.y) AS y FROM b{n} LEFT JOIN m{n} USING (part, entry))")
    body = ",\n".join(steps)
    body = body.replace("floor_div(SUM(x[i])::BIGINT, COUNT(*))", "(SUM(x[i])::BIGINT - ((SUM(x[i])::BIGINT % COUNT(*)) + COUNT(*)) % COUNT(*)) // COUNT(*)")
    return f"""
WITH k AS (
 SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS xs FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT vec_id, label, part, xs[part * (len(xs) // {parts}) + 1:(part + 1) * (len(xs) // {parts})] AS x FROM (SELECT *, unnest(range({parts})) AS part FROM k)),
b0 AS MATERIALIZED (SELECT part, entry, x AS y FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT {entries}) USING (vec_id)),
{body},
f AS MATERIALIZED ({near.format(rounds)}),
c AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, SUM(dist)::BIGINT AS error FROM f GROUP BY vec_id, label)
SELECT vec_id, code, error, (SUM(error) OVER (PARTITION BY label))::BIGINT AS label_error,
 sha256((SELECT string_agg(array_to_string(y, ','), ',' ORDER BY part, entry) FROM b{rounds})) AS codebooks_sha256
FROM c
"""


def queries() -> dict[str, Query]:
    return {
        "op1_packing": op1_packing,
        "op2_secrets": op2_secrets,
        "op3_chat": op3_chat,
        "op4_near_duplicates": op4_near_duplicates,
        "op5_repeats": op5_repeats,
        "op6_quality": op6_quality,
        "op7_licenses": op7_licenses,
        "op8_token_files": op8_token_files,
        "op9_fingerprints": op9_fingerprints,
        "op10_mixing": op10_mixing,
        "op11_token_counts": op11_token_counts,
        "op12_vector_codes": op12_vector_codes,
        "op13_search": op13_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_secrets": OP2_SQL,
        "op3_chat": OP3_SQL,
        "op5_repeats": _op5_sql(),
        "op6_quality": OP6_SQL,
        "op10_mixing": OP10_SQL,
        "op12_vector_codes": _op12_sql(),
        "op13_search": OP13_SQL,
    }
