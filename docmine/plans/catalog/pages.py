"""Selection and page-mining queries over documents and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmine.functions import geometry as G
from docmine.functions import text as T
from docmine.operators import pages as P
from docmine.operators import ordering as O
from docmine.plans import derive as D
from docmine.plans.registry import query

# The invented texts hold no patent phrases, so these lists stand in for the fixed ones.
# They avoid word boundaries, which engines define differently for accented letters.
MARKS = (r"\|", r"token =", r"@", r"[a-z]ed ")
PHRASES = (r"licensed", r"released under", r"the [a-z]+ing", r"de la ")
STARTS = (r"^the ", r"^la ", r"released", r"die der ")

LINES_SQL = """
lines AS (
  SELECT doc_id, source, lang, i::INTEGER AS page_index, ls[i + 1] AS text
  FROM (SELECT doc_id, source, lang, ls, unnest(range(0, len(ls))) AS i
        FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS ls FROM documents)))"""
REGIONS_SQL = (
    LINES_SQL
    + """,
hashed AS (
  SELECT doc_id, page_index, ('0x' || substr(md5('region' || doc_id || ':' || page_index), 1, 8))::BIGINT AS g FROM lines),
regions AS (
  SELECT doc_id, page_index, (30 + g % 200)::INTEGER AS w, (30 + (g // 200) % 200)::INTEGER AS h,
    ((g // 40000) % 30)::INTEGER AS n_lines, ((g // 1200000) % 30)::INTEGER AS n_corners FROM hashed),
drawn AS (
  SELECT DISTINCT doc_id, page_index FROM regions
  WHERE w >= 50 AND h >= 50 AND w::DOUBLE / h BETWEEN 0.1 AND 10 AND n_lines > 10 AND n_corners > 10)"""
)


def any_sql(expr: str, patterns, flags: str = "(?i)") -> str:
    joined = "|".join(f"(?:{p})" for p in patterns)
    return f"regexp_matches({expr}, '{flags}{joined}')"


def lines(t):
    return D.doc_lines(t.documents).withColumnRenamed("line_id", "page_index")


def regions(t):
    g = T.hash_int(F.concat(F.lit("region"), F.col("doc_id"), F.lit(":"), F.col("page_index")))
    return lines(t).select("doc_id", "page_index", g.alias("g")).select(
        "doc_id",
        "page_index",
        (30 + F.col("g") % 200).cast("int").alias("w"),
        (30 + F.floor(F.col("g") / 200) % 200).cast("int").alias("h"),
        (F.floor(F.col("g") / 40000) % 30).cast("int").alias("n_lines"),
        (F.floor(F.col("g") / 1200000) % 30).cast("int").alias("n_corners"),
    )


def rule():
    return T.has_variable_definition(F.col("text"), MARKS, PHRASES)


RULE_SQL = f"({any_sql('text', MARKS)} AND {any_sql('text', PHRASES)})"


@query(
    "mine_pages_funnel",
    f"""WITH {REGIONS_SQL},
    kept AS (SELECT * FROM lines WHERE doc_id IN (SELECT doc_id FROM labels)),
    flags AS (SELECT k.doc_id, {RULE_SQL.replace('text', 'k.text')} AS hit, d.doc_id IS NOT NULL AS drawn
      FROM kept k LEFT JOIN drawn d ON k.doc_id = d.doc_id AND k.page_index = d.page_index),
    docs AS (SELECT doc_id, bool_or(hit) AS any_hit, bool_or(hit AND drawn) AS any_saved FROM flags GROUP BY doc_id)
    SELECT CASE WHEN any_saved THEN 'saved' WHEN any_hit THEN 'no_structure' ELSE 'no_text_hit' END AS status,
      count(*) AS n FROM docs GROUP BY 1""",
)
def mine_pages_funnel(t):
    """Allow-list, text rule, structure rule on the hits, outcome counts."""
    return P.funnel(P.document_status(P.mine_pages(lines(t), t.labels, regions(t), rule())))


@query(
    "mine_pages_documents",
    f"""WITH {REGIONS_SQL},
    saved AS (SELECT l.doc_id, l.page_index FROM lines l JOIN drawn d USING (doc_id, page_index)
      WHERE l.doc_id IN (SELECT doc_id FROM labels) AND {RULE_SQL})
    SELECT doc_id, page_index FROM saved""",
)
def mine_pages_documents(t):
    return P.mine_pages(lines(t), t.labels, regions(t), rule()).filter("saved").select("doc_id", "page_index")


@query(
    "variable_definition_pages",
    f"WITH {LINES_SQL} SELECT doc_id, page_index FROM lines WHERE {RULE_SQL}",
)
def variable_definition_pages(t):
    return P.hit_pages(lines(t), rule())


@query(
    "hit_page_lists",
    f"""WITH {LINES_SQL} SELECT doc_id, array_to_string(list_sort(list(page_index)), ',') AS pages
    FROM lines WHERE {any_sql('text', PHRASES)} GROUP BY doc_id""",
)
def hit_page_lists(t):
    """Hit pages of a document as a list: the pages sit in one row, so nothing is shuffled."""
    hit = lambda line: T.matches_any(line, PHRASES)
    hits = F.filter(
        F.transform(F.split("text", "\n"), lambda line, i: F.when(hit(line), i)),
        lambda i: i.isNotNull(),
    )
    return (
        t.documents.select("doc_id", hits.alias("hits"))
        .filter(F.size("hits") > 0)
        .select("doc_id", F.array_join("hits", ",").alias("pages"))
    )


START_SQL = any_sql("lower(text)", STARTS, "(?im)")


@query(
    "claims_start_pages",
    f"""WITH {LINES_SQL} SELECT doc_id, min(page_index) AS first_hit FROM lines
    WHERE {START_SQL} GROUP BY doc_id""",
)
def claims_start_pages(t):
    return P.first_hit_page(lines(t), T.starts_claims(F.col("text"), STARTS))


@query(
    "older_preamble_documents",
    "SELECT lang, count(*) AS n FROM documents "
    "WHERE regexp_matches(lower(text), '(?im)(?:^claims\\s*[:\\-]?)|(?:^copyright\\b)|(?:^the\\s)') GROUP BY lang",
)
def older_preamble_documents(t):
    """Line-start patterns of the older preamble list, on whole texts."""
    patterns = (T.CLAIM_PREAMBLES_OLD[0], r"^copyright\b", r"^the\s")
    return t.documents.filter(T.starts_claims(F.col("text"), patterns)).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "first_hit_tail",
    f"""WITH {LINES_SQL}, firsts AS (SELECT doc_id, min(page_index) AS first_hit FROM lines WHERE {START_SQL} GROUP BY doc_id)
    SELECT l.doc_id, f.first_hit, count(*)::INTEGER AS n_pages, md5(string_agg(text, chr(10) ORDER BY page_index)) AS text_md5
    FROM lines l JOIN firsts f ON l.doc_id = f.doc_id AND l.page_index >= f.first_hit GROUP BY 1, 2""",
)
def first_hit_tail(t):
    tail = P.tail_from_first_hit(F.split("text", "\n"), lambda p: T.starts_claims(p, STARTS))
    docs = t.documents.select("doc_id", "text")
    found = docs.select("doc_id", F.array(tail).alias("s")).select("doc_id", F.explode("s").alias("s"))
    return (
        found.filter("s is not null")
        .select("doc_id", "s.first_hit", "s.n_pages", F.md5("s.text").alias("text_md5"))
    )


@query(
    "pages_from_first_hit",
    f"""WITH {LINES_SQL}, firsts AS (SELECT doc_id, min(page_index) AS first_hit FROM lines WHERE {START_SQL} GROUP BY doc_id)
    SELECT l.doc_id, l.page_index FROM lines l JOIN firsts f ON l.doc_id = f.doc_id AND l.page_index >= f.first_hit""",
)
def pages_from_first_hit(t):
    return P.pages_from_first_hit(lines(t), T.starts_claims(F.col("text"), STARTS)).select(
        "doc_id", "page_index"
    )


@query(
    "mine_claims_status",
    f"""WITH {REGIONS_SQL},
    firsts AS (SELECT doc_id, min(page_index) AS first_hit FROM lines WHERE {START_SQL} GROUP BY doc_id),
    flags AS (SELECT l.doc_id, f.first_hit, l.page_index >= f.first_hit AS inside, {RULE_SQL} AS hint, d.doc_id IS NOT NULL AS drawn
      FROM lines l LEFT JOIN firsts f ON l.doc_id = f.doc_id LEFT JOIN drawn d ON l.doc_id = d.doc_id AND l.page_index = d.page_index)
    SELECT doc_id, first_hit, count(*) FILTER (inside) AS n_pages, coalesce(bool_or(inside AND hint), false) AS hint,
      CASE WHEN first_hit IS NULL THEN 'no_claims' WHEN bool_or(inside AND drawn) THEN 'saved' ELSE 'no_structure' END AS status
    FROM flags GROUP BY doc_id, first_hit""",
)
def mine_claims_status(t):
    return P.mine_claims(lines(t), regions(t), T.starts_claims(F.col("text"), STARTS), rule())


EXAMPLE_TEXT = (
    "CASE page_index % 4 WHEN 0 THEN 'Example ' || page_index || 'a: Preparation of ' || text "
    "WHEN 1 THEN '  synthesis of ' || text WHEN 2 THEN 'see the synthesis of ' || text ELSE text END"
)


def example_lines(t):
    i = F.col("page_index")
    return lines(t).withColumn(
        "text",
        F.when(i % 4 == 0, F.concat(F.lit("Example "), i, F.lit("a: Preparation of "), F.col("text")))
        .when(i % 4 == 1, F.concat(F.lit("  synthesis of "), F.col("text")))
        .when(i % 4 == 2, F.concat(F.lit("see the synthesis of "), F.col("text")))
        .otherwise(F.col("text")),
    )


@query(
    "mine_examples",
    f"""WITH {LINES_SQL} SELECT doc_id, page_index FROM (SELECT doc_id, page_index, {EXAMPLE_TEXT} AS text FROM lines)
    WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
      AND regexp_matches(text, '(?i)example\\s+\\d+[a-z]?\\s*[:.\\-\\s]\\s*(preparation|synthesis)\\s+of')""",
)
def mine_examples(t):
    """Worked-example pages of the documents an earlier stage kept."""
    return P.mine_examples(example_lines(t), t.labels.filter("quality = 1"))


@query(
    "example_names",
    f"""WITH {LINES_SQL} SELECT DISTINCT source, name FROM (
      SELECT source, nullif(trim(regexp_extract({EXAMPLE_TEXT},
        '(?im)^\\s*(?:example(?:\\s+\\d+\\s*[a-z]?)?\\s*[:\\-.\\r\\n]\\s*)?(?:synthesis|preparation)\\s+of\\s+(.+)$', 1)), '') AS name
      FROM lines) WHERE name IS NOT NULL""",
)
def example_names(t):
    """Names behind the example phrase, each once per source."""
    named = example_lines(t).select("source", T.example_name(F.col("text")).alias("name"))
    return named.filter("name is not null").dropDuplicates(["source", "name"])


@query(
    "phrase_documents",
    "SELECT source, count(*) AS n FROM documents WHERE contains(text, 'The ') OR contains(text, 'La ') "
    "OR contains(text, ' licensed') GROUP BY source",
)
def phrase_documents(t):
    hit = T.any_phrase(F.col("text"), ("The ", "La ", " licensed"))
    return t.documents.filter(hit).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(
    "word_flags",
    "SELECT doc_id, contains(text, 'token') AS exact_word, contains(lower(text), 'license') AS any_case, "
    "contains(text, 'R') OR contains(source, '7') AS marked, lower(text) LIKE '%copyright%' OR lower(text) LIKE '%apache%' AS excluded FROM documents",
)
def word_flags(t):
    """Substring tests: exact case, any case, marker in one of two columns, topic list."""
    text = F.col("text")
    marked = T.contains_word(text, "R") | T.has_marker(F.col("source"), F.lit(None).cast("string"), "7")
    return t.documents.select(
        "doc_id",
        T.contains_word(text, "token").alias("exact_word"),
        T.contains_ci(text, "License").alias("any_case"),
        marked.alias("marked"),
        T.excluded_topic(text, ("copyright", "apache")).alias("excluded"),
    )


@query(
    "vocab_reject",
    "SELECT (NOT regexp_matches(text, '[^A-Za-z0-9 .,]')) AS inside, count(*) AS n FROM "
    "(SELECT unnest(string_split(text, chr(10))) AS text FROM documents) GROUP BY 1",
)
def vocab_reject(t):
    """Lines made of allowed characters only, against the rest."""
    ok = T.in_alphabet(F.col("text"), r" .,")
    return D.doc_lines(t.documents).groupBy(ok.alias("inside")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "blank_lines",
    "SELECT source, count(*) FILTER (trim(text) = '') AS blank, count(*) AS n FROM "
    "(SELECT source, unnest(string_split(text, chr(10))) AS text FROM documents) GROUP BY source",
)
def blank_lines(t):
    """Rows kept but flagged when they hold no text."""
    return D.doc_lines(t.documents).groupBy("source").agg(
        F.count_if(T.is_blank(F.col("text"))).alias("blank"), F.count(F.lit(1)).alias("n")
    )


@query(
    "collapsed_texts",
    "SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS flat FROM documents",
)
def collapsed_texts(t):
    return t.documents.select("doc_id", F.md5(T.collapse_whitespace(F.col("text"))).alias("flat"))


@query(
    "url_stems",
    "SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)/*$', 1), '^(.+)\\.[^.]+$', '\\1') AS stem, "
    "CASE WHEN starts_with(url, '/') THEN url ELSE 'root/' || url END AS full_path FROM pages",
)
def url_stems(t):
    return t.pages.select(
        "page_id",
        T.file_stem(F.col("url")).alias("stem"),
        T.resolve_path("root", F.col("url")).alias("full_path"),
    )


@query(
    "fixed_width_subclass",
    "SELECT DISTINCT substr(line, 11, 8) AS patent_no FROM (SELECT lpad(p_partkey::VARCHAR, 10, '0') "
    "|| lpad((p_partkey // 3)::VARCHAR, 8, '0') || substr(p_brand, 6, 4) AS line FROM part) "
    "WHERE length(line) >= 22 AND substr(line, 19, 4) IN ('#11', '#111', '#12', 'd#1', '#17', '#2') "
    "OR length(line) >= 21 AND substr(line, 19, 3) IN ('#11', '#17')",
)
def fixed_width_subclass(t):
    """Fixed-width lines cut into number and subclass; numbers of the listed subclasses."""
    text = F.concat(
        F.lpad(F.col("p_partkey").cast("string"), 10, "0"),
        F.lpad(F.floor(F.col("p_partkey") / 3).cast("string"), 8, "0"),
        F.substring("p_brand", 6, 4),
    )
    fields = [("patent_no", 11, 8), ("subclass", 19, 4)]
    cut = P.cut_fixed_width(t.part.select(text.alias("value")), fields, 21)
    return P.filter_subclass(cut, "subclass", ["#11", "#17"]).select("patent_no").distinct()


@query("key_list", "SELECT DISTINCT o_custkey FROM orders ORDER BY 1")
def key_list(t):
    return t.orders.select("o_custkey").distinct().orderBy("o_custkey")


@query(
    "key_counts",
    "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(*) AS n FROM orders GROUP BY 1",
)
def key_counts(t):
    """Distinct keys per group. Pairs are reduced first, so a hot group is never one task."""
    pairs = t.orders.groupBy("o_orderpriority", "o_custkey").agg(F.count(F.lit(1)).alias("m"))
    return pairs.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("m").alias("n")
    )


@query(
    "brand_filter",
    "SELECT p_brand, count(*) AS n FROM part WHERE p_brand IN ('Brand#1', 'Brand#11', 'Brand#20') GROUP BY 1",
)
def brand_filter(t):
    kept = P.filter_subclass(t.part, "p_brand", ["Brand#1", "Brand#11", "Brand#20"])
    return kept.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@query(
    "valid_labels",
    "SELECT p_type, regexp_matches(p_type, '^\\p{Lu}[\\p{L}\\p{N}]{0,5}$') AS valid, count(*) AS n FROM "
    "(SELECT unnest(string_split(p_name || ' ' || p_brand || ' ' || p_type || ' R' || p_size, ' ')) AS p_type FROM part) GROUP BY 1",
)
def valid_labels(t):
    names = F.concat_ws(" ", "p_name", "p_brand", "p_type", F.concat(F.lit("R"), F.col("p_size")))
    return (
        t.part.select(F.explode(F.split(names, " ")).alias("p_type"))
        .groupBy("p_type", T.is_valid_label(F.col("p_type")).alias("valid"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "allowed_orders",
    "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1",
)
def allowed_orders(t):
    keys = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return P.keep_allowed(t.orders, keys, "o_custkey").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    "existing_documents",
    "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
)
def existing_documents(t):
    """Rows whose artefact is listed."""
    return P.keep_allowed(t.documents.select("doc_id", "source"), t.labels, "doc_id")


@query(
    "remaining_lines",
    "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1",
)
def remaining_lines(t):
    taken = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return P.exclude_already(t.lineitem, taken, "l_orderkey").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "membership_overlap",
    "SELECT source, count(*) AS n, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS members, "
    "round(100.0 * count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) / count(*), 6) AS pct FROM documents GROUP BY 1",
)
def membership_overlap(t):
    marked = P.mark_membership(t.documents.select("doc_id", "source"), t.labels, "doc_id")
    return marked.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("member").alias("members"),
        F.round(F.count_if("member") * 100.0 / F.count(F.lit(1)), 6).alias("pct"),
    )


@query(
    "dedupe_within_source",
    "SELECT source, count(*) AS n FROM (SELECT DISTINCT source, text FROM documents) GROUP BY 1",
)
def dedupe_within_source(t):
    """Exact copies inside a source, found through a 128-bit digest of the whole text."""
    slim = t.documents.select("source", F.md5("text").alias("digest"))
    return slim.dropDuplicates(["source", "digest"]).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(
    "label_fail_rate",
    "SELECT toxic, count(*) FILTER (quality = 0) AS failed, count(*) AS attempts, "
    "round(count(*) FILTER (quality = 0) / count(*), 6) AS fail_rate FROM labels GROUP BY 1",
)
def label_fail_rate(t):
    rates = P.fail_rate(t.labels, F.col("quality") == 0, ["toxic"])
    return rates.withColumn("fail_rate", F.round("fail_rate", 6))


NAMES_SQL = (
    LINES_SQL
    + """,
names AS (SELECT doc_id, regexp_replace(n, '^\\s+|\\s+$', '', 'g') AS name FROM (SELECT doc_id, unnest(string_split(text, '.')) AS n FROM lines)),
named AS (SELECT * FROM names WHERE name <> ''),
resolver AS (SELECT DISTINCT name, substr(md5(name), 1, 8) AS structure FROM named WHERE ('0x' || substr(md5(name), 9, 4))::BIGINT % 3 = 0)"""
)


def name_tables(t):
    """(answers with their names one per line, lookup table of a third of all names)."""
    response = F.replace(F.col("text"), F.lit("."), F.lit("\n"))
    answers = t.documents.select("doc_id", response.alias("response"))
    names = answers.select(F.explode(T.list_items(F.col("response"))).alias("name")).distinct()
    known = names.filter(T.hash_int(F.col("name"), 9, 4) % 3 == 0)
    return answers, known.select("name", F.substring(F.md5("name"), 1, 8).alias("structure"))


@query("mined_names", f"WITH {NAMES_SQL} SELECT DISTINCT doc_id, name, structure FROM named JOIN resolver USING (name)")
def mined_names(t):
    """List-like answers split into names, resolved by a lookup table, each once."""
    return P.mine_names(*name_tables(t))[0]


@query(
    "mined_names_fail_rate",
    f"""WITH {NAMES_SQL}
    SELECT count(*) FILTER (r.name IS NULL) AS failed, count(*) AS attempts, round(count(*) FILTER (r.name IS NULL) / count(*), 6) AS fail_rate
    FROM named n LEFT JOIN resolver r ON n.name = r.name""",
)
def mined_names_fail_rate(t):
    return P.mine_names(*name_tables(t))[1].withColumn("fail_rate", F.round("fail_rate", 6))


@query(
    "list_output_rows",
    f"WITH {LINES_SQL} SELECT doc_id, count(*) AS n FROM lines WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '' GROUP BY doc_id",
)
def list_output_rows(t):
    return t.documents.select("doc_id", F.size(T.list_items(F.col("text"))).cast("bigint").alias("n")).filter("n > 0")


@query(
    "describe_documents",
    "SELECT * FROM (SELECT 'doc_id' AS column_name, true AS present, true AS expected, count(doc_id) AS non_null, count(*) AS n_rows FROM documents "
    "UNION ALL SELECT 'text', true, true, count(text), count(*) FROM documents "
    "UNION ALL SELECT 'lang', true, false, count(lang), count(*) FROM documents "
    "UNION ALL SELECT 'source', true, false, count(source), count(*) FROM documents "
    "UNION ALL SELECT 'n_chars', true, false, count(n_chars), count(*) FROM documents "
    "UNION ALL SELECT 'mol_path', false, true, 0, count(*) FROM documents)",
)
def describe_documents(t):
    return P.describe_input(t.documents, ["doc_id", "text", "mol_path"])


@query(
    "row_index_ids",
    "SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS row_id, "
    "'images/' || (row_number() OVER (ORDER BY source, doc_id) - 1) || '.png' AS file_path FROM documents",
)
def row_index_ids(t):
    """Sequential ids over a stated key: ranks inside (source, id range), shifted by offsets."""
    ranked = O.rank_in_order(
        t.documents.select("doc_id", "source"),
        [],
        {"source": F.col("source"), "range": F.floor(F.col("doc_id") / 65536)},
        [F.col("doc_id")],
    )
    return ranked.select(
        "doc_id",
        (F.col("rank") - 1).alias("row_id"),
        F.concat(F.lit("images/"), F.col("rank") - 1, F.lit(".png")).alias("file_path"),
    )


@query(
    "union_sources",
    "SELECT origin, count(*) AS n, count(acct) AS with_acct FROM (SELECT 'orders' AS origin, o_custkey AS key, NULL AS acct FROM orders "
    "UNION ALL SELECT 'customer', c_custkey, c_acctbal FROM customer) GROUP BY 1",
)
def union_sources(t):
    """Bag union with an origin tag; columns missing on one side become null."""
    a = t.orders.select(F.lit("orders").alias("origin"), F.col("o_custkey").alias("key"))
    b = t.customer.select(
        F.lit("customer").alias("origin"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("acct")
    )
    return a.unionByName(b, allowMissingColumns=True).groupBy("origin").agg(
        F.count(F.lit(1)).alias("n"), F.count("acct").alias("with_acct")
    )


@query(
    "merged_item_lists",
    "SELECT item, count(*) AS n FROM (SELECT lang AS item FROM documents UNION ALL SELECT event_type FROM events "
    "UNION ALL SELECT role FROM conversations) GROUP BY 1",
)
def merged_item_lists(t):
    """Item lists of several sources under one name."""
    parts = [
        t.documents.select(F.col("lang").alias("item")),
        t.events.select(F.col("event_type").alias("item")),
        t.conversations.select(F.col("role").alias("item")),
    ]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return merged.groupBy("item").agg(F.count(F.lit(1)).alias("n"))


@query(
    "set_difference_keys",
    "SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders",
)
def set_difference_keys(t):
    return t.customer.select(F.col("c_custkey").alias("key")).subtract(t.orders.select("o_custkey"))


@query(
    "sample_intersection",
    "WITH a AS (SELECT o_orderkey FROM orders ORDER BY md5('1|' || o_orderkey), o_orderkey LIMIT (SELECT count(*) // 4 FROM orders)), "
    "b AS (SELECT o_orderkey FROM orders ORDER BY md5('2|' || o_orderkey), o_orderkey LIMIT (SELECT count(*) // 4 FROM orders)) "
    "SELECT count(*) AS common, round(count(*) * 100.0 / (SELECT count(*) FROM a), 6) AS pct FROM (SELECT * FROM a INTERSECT SELECT * FROM b)",
)
def sample_intersection(t):
    """Keys two seeded quarter samples share, and the rate."""
    keys = t.orders.select("o_orderkey")

    def quarter(seed):
        ranked = O.rank_by_hash(keys, [], ["o_orderkey"], seed, "rank", "total")
        return ranked.filter(F.col("rank") <= F.floor(F.col("total") / 4)).select("o_orderkey")

    both = P.mark_membership(quarter(1), quarter(2), "o_orderkey")
    return both.agg(
        F.count_if("member").alias("common"),
        F.round(F.count_if("member") * 100.0 / F.count(F.lit(1)), 6).alias("pct"),
    )


@query(
    "hardest_rows",
    "SELECT * FROM (SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50)",
)
def hardest_rows(t):
    """Rows with the highest loss, kept for a second pass."""
    return (
        t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
        .orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
        .limit(50)
    )


@query(
    "text_like_components",
    "WITH c AS (SELECT l_quantity::INTEGER AS w, (l_linenumber * 6)::INTEGER AS h, (l_extendedprice / 1000)::INTEGER AS area, "
    "l_tax * 5000 AS hull, l_returnflag FROM (SELECT l_returnflag, l_quantity, l_linenumber, floor(l_extendedprice / 1000) * 1000 AS l_extendedprice, l_tax FROM lineitem)) "
    "SELECT l_returnflag, count(*) AS n, count(*) FILTER (h > 5 AND h < 40 AND w::DOUBLE / h > 0.1 AND w::DOUBLE / h < 5 "
    "AND CASE WHEN hull > 0 THEN area / hull ELSE 0 END > 0.25) AS text_like FROM c WHERE area >= 15 GROUP BY 1",
)
def text_like_components(t):
    """Component rule on numeric rows; noise below 15 pixels goes first."""
    parts = t.lineitem.select(
        "l_returnflag",
        F.col("l_quantity").cast("int").alias("w"),
        (F.col("l_linenumber") * 6).cast("int").alias("h"),
        F.floor(F.col("l_extendedprice") / 1000).cast("int").alias("area"),
        (F.col("l_tax") * 5000).alias("hull"),
    ).filter("area >= 15")
    rule = G.is_text_like(F.col("w"), F.col("h"), F.col("area"), F.col("hull"))
    return parts.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(rule).alias("text_like")
    )


@query(
    "structure_region_pages",
    f"WITH {REGIONS_SQL} SELECT * FROM drawn",
)
def structure_region_pages(t):
    return P.structure_pages(regions(t))


# Phrases put before the lines, so that the fixed rules meet hits for each of their patterns
# and near misses. The lines are cut to ASCII, where word boundaries are the same in all engines.
PHRASED = (
    "R1 is hydrogen", "an R-group", "the R group", "R(2)methyl",
    "selected from the group consisting essentially of", "selected from the group comprising", "selected from a group of",
    "wherein R2 is", "wherein said substituents are", "R1 to R4", "each R1 is a C1-4 alkyl", "group consisting essentially of",
    "What is claimed is:", "the following claims:", "that which is claimed is", "We claim:",
    "claims: 1", "what is claim is", "what are claims is", "the invention claimed is",
    "Rx group", "selected for the group", "claimed what", "we claimed it",
)
PHRASED_SQL = (
    LINES_SQL
    + f""",
phrased AS (SELECT doc_id, page_index, p[(h // 65536) % {len(PHRASED)} + 1] || ' ' || p[h % 65536 % {len(PHRASED)} + 1] || chr(10) || regexp_replace(text, '[^ -~]', '', 'g') AS text
  FROM (SELECT *, ('0x' || substr(md5('phrase' || doc_id || ':' || page_index), 1, 8))::BIGINT AS h, {list(PHRASED)!r} AS p FROM lines))"""
)


def phrased(t):
    h = T.hash_int(F.concat(F.lit("phrase"), F.col("doc_id"), F.lit(":"), F.col("page_index")))
    table = F.array(*[F.lit(p) for p in PHRASED])
    pick = lambda k: F.get(table, (k % len(PHRASED)).cast("int"))
    plain = F.regexp_replace("text", "[^ -~]", "")
    return lines(t).withColumn("h", h).select(
        "doc_id", "page_index",
        F.concat(pick(F.floor(F.col("h") / 65536)), F.lit(" "), pick(F.col("h") % 65536), F.lit("\n"), plain).alias("text"),
    )


@query(
    "fixed_page_rules",
    f"""WITH {PHRASED_SQL} SELECT doc_id, page_index,
      {any_sql('text', T.PLACEHOLDERS)} AND {any_sql('text', T.DEFINITIONS)} AS defines,
      {any_sql('lower(text)', T.CLAIM_PREAMBLES, '(?im)')} AS claims, {any_sql('lower(text)', T.CLAIM_PREAMBLES_OLD, '(?im)')} AS claims_old FROM phrased""",
)
def fixed_page_rules(t):
    """The variable-definition rule and both claim-start rules with their own fixed lists."""
    text = F.col("text")
    return phrased(t).select(
        "doc_id", "page_index", T.has_variable_definition(text).alias("defines"), T.starts_claims(text).alias("claims"),
        T.starts_claims(text, T.CLAIM_PREAMBLES_OLD).alias("claims_old"),
    )


@query(
    "fixed_rule_hits",
    f"""WITH {PHRASED_SQL} SELECT rule, nr, count(*) AS n FROM ("""
    + " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, {i} AS nr FROM phrased WHERE regexp_matches({expr}, '{flags}{p}')"
        for rule, expr, flags, patterns in (
            ("placeholder", "text", "(?i)", T.PLACEHOLDERS), ("definition", "text", "(?i)", T.DEFINITIONS),
            ("claims", "lower(text)", "(?im)", T.CLAIM_PREAMBLES), ("claims_old", "lower(text)", "(?im)", T.CLAIM_PREAMBLES_OLD),
        )
        for i, p in enumerate(patterns)
    )
    + ") GROUP BY ALL",
)
def fixed_rule_hits(t):
    """Lines that each single pattern of the fixed lists matches."""
    text = F.col("text")
    rules = (
        ("placeholder", text, "(?i)", T.PLACEHOLDERS), ("definition", text, "(?i)", T.DEFINITIONS),
        ("claims", F.lower(text), "(?im)", T.CLAIM_PREAMBLES), ("claims_old", F.lower(text), "(?im)", T.CLAIM_PREAMBLES_OLD),
    )
    hits = [
        F.when(T.matches_any(expr, [p], flags), F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("nr")))
        for rule, expr, flags, patterns in rules
        for i, p in enumerate(patterns)
    ]
    return phrased(t).select(F.explode(F.array_compact(F.array(*hits))).alias("h")).groupBy("h.rule", "h.nr").agg(F.count(F.lit(1)).alias("n"))
