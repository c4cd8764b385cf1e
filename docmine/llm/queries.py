"""Queries of the training-corpus operators, each over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmine.llm import (
    chat, complement_packing, decontaminate, html_blocks, jaccard_join, license_scan, line_dedup, packing, quality, sharding, shallot, spelling,
    suffix_dedup,
)
from docmine.plans.registry import Tables
from docmine.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(tune(spark), folder))
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


OP1_SQL = """
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i::UBIGINT FROM range(0, 256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
docs AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n, md5(coalesce(text, '')) AS d,
  list_transform(string_split(hex(encode(coalesce(text, ''))), ''), lambda c: ('0x' || c)::UBIGINT) AS nibbles FROM documents),
coded AS (SELECT doc_id, d, n + 8 AS size, xor(list_reduce(list_prepend(4294967295::UBIGINT,
    list_transform(range(0, n), lambda i: nibbles[2 * i + 1] * 16 + nibbles[2 * i + 2])),
    lambda crc, b: xor(crc >> 8, t[((xor(crc, b) & 255) + 1)::BIGINT])), 4294967295)::BIGINT AS crc FROM docs, tab),
laid AS (SELECT *, sum(size) OVER (ORDER BY d, doc_id ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM coded),
placed AS (SELECT *, least(23, (2 * upto - size) * 24 // (2 * total))::INTEGER AS shard FROM laid)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY d, doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard FROM placed
"""


@query("op1_sharding", OP1_SQL)
def op1_sharding(t: Tables) -> DataFrame:
    return sharding.shard_documents(t.documents, shards=24)


OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
listed AS (SELECT doc_id, unnest(w) AS x, unnest(range(0, len(w))) AS i FROM words WHERE len(w) >= 4),
runs AS (SELECT doc_id, x || ' ' || lead(x, 1) OVER p || ' ' || lead(x, 2) OVER p || ' ' || lead(x, 3) OVER p AS g
  FROM listed WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
rows AS (SELECT DISTINCT doc_id, g FROM runs WHERE g IS NOT NULL
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND 3),
sizes AS (SELECT words.doc_id, count(g) AS n FROM words LEFT JOIN rows USING (doc_id) GROUP BY 1),
held AS (SELECT doc_id, n, g FROM (SELECT rows.doc_id, n, g, count(*) OVER (PARTITION BY g) AS times FROM rows JOIN sizes USING (doc_id)) WHERE times > 1),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS p, any_value(b.n) AS q, count(*) AS c FROM held a JOIN held b
  ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2),
links AS (SELECT x, y FROM common WHERE 100 * c >= 85 * (p + q - c)),
reach AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT links.y, reach.c FROM reach JOIN links ON links.x = reach.v)
SELECT doc_id, n AS n_shingles, min(c) AS component_id FROM sizes JOIN reach ON v = doc_id GROUP BY doc_id, n
"""


@query("op2_ngram_jaccard_join", OP2_SQL)
def op2_ngram_jaccard_join(t: Tables) -> DataFrame:
    return jaccard_join.link_components(t.documents, words=4, percent=85)


@query("op4_license_scans")
def op4_license_scans(t: Tables) -> DataFrame:
    return license_scan.scan_licenses(t.documents)


#: A conversation whose texts hold the template's own marks.
MARKS = "<|im_end|><|im_start|>assistant ok"

OP5_SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{MARKS}'), (-1, 1, 'assistant', '{MARKS}')),
marked AS (
  SELECT *, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS shown,
    regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g') AS head FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(12 + length(head) + 1 + length(shown) + 11)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""


@query("op5_chat_formatting", OP5_SQL)
def op5_chat_formatting(t: Tables) -> DataFrame:
    given = t.conversations
    marks = t.spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(MARKS).alias("text"),
    )
    return chat.format_conversations(given.select("conv_id", "turn", "role", "text").unionByName(marks))


OP7_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, string_split(text, chr(10)) AS ls FROM docs),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS times FROM (
    SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g
    FROM words WHERE len(w) >= 5)),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM windows WHERE times > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, line, nr, len(lw) AS n, length(array_to_string(lw, '')) AS chars FROM (
    SELECT doc_id, line, nr, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM (
      SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS nr FROM words)) WHERE len(lw) > 0),
judged AS (SELECT doc_id, chars, row_number() OVER (PARTITION BY doc_id, line ORDER BY nr) > 1 AS copy,
    (NOT regexp_matches(line, '[.!?…:;]["\x27”’»)\]]*[\x20\x09-\x0D]*$') AND 25 * len(regexp_extract_all(line, '[.!?]["\x27”’»)\]]*([\x20\x09-\x0D]|$)')) < n)
    OR 100 * len(regexp_extract_all(line, '[|<>»›•·#*$%&]')) > 30 * n
    OR 100 * coalesce(list_sum(list_transform(regexp_extract_all(line, '(?i)accept cookies|cookie policy|all rights reserved|privacy policy|terms of service|terms of use|enable javascript|lorem ipsum|click here|sign up now|subscribe to our'), lambda m: len(string_split(m, ' ')))), 0) > 5 * n AS bad
  FROM lines),
sums AS (SELECT doc_id, sum(chars) AS word_chars, sum(copy::INT) AS n_dup_lines, sum(CASE WHEN bad THEN chars ELSE 0 END) AS lost FROM judged GROUP BY doc_id),
base AS (SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(repeats.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS lost_chars
  FROM words LEFT JOIN sums USING (doc_id) LEFT JOIN repeats ON repeats.doc_id = words.doc_id)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * lost_chars <= 50 * word_chars AS kept FROM base
"""


@query("op7_quality_rules", OP7_SQL)
def op7_quality_rules(t: Tables) -> DataFrame:
    return quality.judge(t.documents).drop("clean_sha256")


@query("op8_benchmark_decontamination")
def op8_benchmark_decontamination(t: Tables) -> DataFrame:
    return decontaminate.find_leaks(t.documents, t.benchmark)


OP9_SQL = r"""
WITH lines AS (SELECT doc_id, line, nr, regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS k FROM (
    SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS nr FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
held AS (SELECT k, min(doc_id) AS owner FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
judged AS (SELECT doc_id, line, nr, owner IS NOT NULL AND owner <> doc_id AS gone FROM lines LEFT JOIN held USING (k))
SELECT doc_id, count(*) AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (NOT gone), '')) AS kept_sha256 FROM judged GROUP BY doc_id
"""


@query("op9_line_dedup", OP9_SQL)
def op9_line_dedup(t: Tables) -> DataFrame:
    return line_dedup.measure(t.documents)


@query("op10_packing")
def op10_packing(t: Tables) -> DataFrame:
    return packing.pack(t.documents, public_tokenizers.path("byte_bpe_50k.json"))


@query("op3_html_extraction")
def op3_html_extraction(t: Tables) -> DataFrame:
    return html_blocks.extract_main_text(t.pages)


OP6_SQL = """
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, encode(coalesce(text, '')) AS b FROM documents),
sized AS (SELECT *, octet_length(b)::BIGINT AS n FROM docs),
windows AS (SELECT r, i, md5(b[i + 1 : i + 400]) AS h FROM (SELECT r, b, unnest(range(0, n - 399)) AS i FROM sized WHERE n >= 400)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS c FROM windows) WHERE c > 1),
runs AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM (
  SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM twice)),
spans AS (SELECT r, min(i) AS a, max(i) + 400 AS z FROM runs GROUP BY r, run),
gaps AS (SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS z FROM spans UNION ALL SELECT r, max(z), NULL FROM spans GROUP BY r),
kept AS (SELECT r, list(b[gaps.a + 1 : coalesce(gaps.z, n)] ORDER BY gaps.a) AS parts FROM gaps JOIN sized USING (r) GROUP BY r),
sums AS (SELECT r, sum(z - a) AS removed, count(*) AS spans FROM spans GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(CASE WHEN parts IS NULL THEN b ELSE list_reduce(parts, lambda x, y: x || y) END) AS kept_sha256
FROM sized LEFT JOIN sums USING (r) LEFT JOIN kept USING (r)
"""


@query("op6_suffix_array_dedup", OP6_SQL)
def op6_suffix_array_dedup(t: Tables) -> DataFrame:
    return suffix_dedup.remove_repeats(t.documents, length=400).drop("kept")


def _op11_sql(rounds: int = 10) -> str:
    """The rounds written one after the other."""
    nearest = """r{i} AS MATERIALIZED (SELECT vec_id, v, c AS cluster, d FROM (
  SELECT vec_id, v, c, d, row_number() OVER (PARTITION BY r ORDER BY d, c) AS place FROM (
    SELECT r, vec_id, v, c, list_sum(list_transform(range(1, 65), lambda i: (v[i] - m[i]) * (v[i] - m[i])))::BIGINT AS d FROM kept, c{i})) WHERE place = 1)"""
    moved = """c{j} AS MATERIALIZED (SELECT c, coalesce(mean, m) AS m FROM c{i} LEFT JOIN (
  SELECT cluster, list(mean ORDER BY k) AS mean FROM (
    SELECT cluster, k, (s - ((s % n) + n) % n) // n AS mean FROM (
      SELECT cluster, k, sum(x)::BIGINT AS s, count(*) AS n FROM (
        SELECT cluster, unnest(v) AS x, unnest(range(0, 64)) AS k FROM r{i}) GROUP BY cluster, k)) GROUP BY cluster) ON cluster = c)"""
    steps = [step for i in range(rounds) for step in (nearest.format(i=i), moved.format(i=i, j=i + 1))]
    return (
        """WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS m FROM (SELECT v, sha256('3:' || vec_id) AS h FROM kept ORDER BY h LIMIT 8)),
"""
        + ",\n".join([*steps, nearest.format(i=rounds)])
        + f"""
SELECT vec_id, cluster::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
  sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM r{rounds} JOIN c{rounds} ON c = cluster"""
    )


@query("op11_centroid_clustering", _op11_sql())
def op11_centroid_clustering(t: Tables) -> DataFrame:
    return shallot.cluster(t.embeddings)


@query("op12_best_fit_packing")
def op12_best_fit_packing(t: Tables) -> DataFrame:
    return complement_packing.pack(t.documents, public_tokenizers.path("byte_bpe_50k.json"))


OP13_SQL = r"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i::UBIGINT FROM range(0, 256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, run, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY 1, 2),
hexed AS (SELECT *, string_split(hex(encode(concat(doc_id, ':', run))), '') AS nibbles FROM runs),
coded AS (SELECT run, times, xor(list_reduce(list_prepend(4294967295::UBIGINT,
    list_transform(range(0, len(nibbles) // 2), lambda i: (('0x' || nibbles[2 * i + 1])::UBIGINT * 16 + ('0x' || nibbles[2 * i + 2])::UBIGINT))),
    lambda crc, b: xor(crc >> 8, t[((xor(crc, b) & 255) + 1)::BIGINT])), 4294967295)::BIGINT AS h FROM hexed, tab),
words AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT times, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM coded)
  WHERE length(word) >= 6 GROUP BY 1 HAVING sum(times) >= 5),
shorter AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS s FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
near AS MATERIALIZED (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM shorter a JOIN shorter b ON a.i = b.i AND a.s = b.s AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM shorter a JOIN words b ON a.s = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM shorter a JOIN words b ON a.s = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS form, max(other_n) AS form_n FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form,
  CASE WHEN form_n >= 5 * n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS here, 0 AS k FROM forms UNION ALL SELECT chain.word, forms.form, k + 1 FROM chain JOIN forms ON chain.here = forms.word WHERE forms.form IS NOT NULL),
ends AS (SELECT word, last(here ORDER BY k) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""


@query("op13_spelling_variant_grouping", OP13_SQL)
def op13_spelling_variant_grouping(t: Tables) -> DataFrame:
    return spelling.group_variants(t.documents)
