"""Similarity search and clusters over shingled texts and embedding signs."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmine.functions import runs as R
from docmine.functions import scalars as N
from docmine.functions import structures as S
from docmine.functions.text import collapse_whitespace
from docmine.operators import dense
from docmine.operators import pages as P
from docmine.operators import sampling as M
from docmine.operators import search as C
from docmine.plans import derive as D
from docmine.plans import jobs as J
from docmine.plans.catalog.structures import KEY_SQL
from docmine.plans.registry import query
from docmine.session import materialise

SLOTS = 1 << 20


def bits_sql(name, table, key, n=3, slots=SLOTS):
    return f"""{name} AS (
  SELECT id, list_sort(list_distinct(list_transform(range(0, greatest(len(ws) - {n}, 0) + 1),
    lambda i: (('0x' || substr(md5(array_to_string(ws[i + 1 : i + {n}], ' ')), 1, 8))::BIGINT % {slots})::INTEGER))) AS bits
  FROM (SELECT {key} AS id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ws FROM {table}) WHERE len(ws) > 0)"""


def text_bits(df, key, n=3):
    return R.text_bits(df, key, "text", n, SLOTS)


DOC_BITS = bits_sql("docs", "documents", "doc_id")
ITEM_BITS = bits_sql("items", "benchmark", "item_id")
SIGN_BITS = "signs AS (SELECT vec_id AS id, list_filter(range(0, 64), lambda i: embedding[i + 1] > 0) AS bits FROM embeddings)"


def sign_rows(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), N.sign_bits(F.col("embedding")).alias("bits"))


def range_sql(left, right, cond, sim="c::DOUBLE / (len(a.bits) + len(b.bits) - c)"):
    """Pairs sharing a bit through an inverted list, so the SQL stays feasible."""
    return f"""counted AS (SELECT x.id AS query_id, y.id AS id, count(*) AS c FROM
      (SELECT id, unnest(bits) AS bit FROM {left}) x JOIN (SELECT id, unnest(bits) AS bit FROM {right}) y ON x.bit = y.bit GROUP BY 1, 2),
    scored AS (SELECT query_id, k.id, {sim} AS sim FROM counted k JOIN {left} a ON a.id = query_id JOIN {right} b ON b.id = k.id),
    hits AS (SELECT * FROM scored WHERE {cond})"""


@query(
    "shingle_bit_counts",
    f"WITH {DOC_BITS} SELECT id, len(bits)::INTEGER AS n_bits, list_sum(bits)::BIGINT AS bit_sum FROM docs",
)
def shingle_bit_counts(t):
    rows = text_bits(t.documents, "doc_id")
    total = F.aggregate("bits", F.lit(0).cast("bigint"), lambda acc, b: acc + b)
    return rows.select("id", N.bit_count(F.col("bits")).alias("n_bits"), total.alias("bit_sum"))


@query(
    "similarity_band",
    f"WITH {DOC_BITS}, {ITEM_BITS}, {range_sql('items', 'docs', 'sim BETWEEN 0.05 AND 0.9')} SELECT query_id, id, round(sim, 6) AS sim FROM hits",
)
def similarity_band(t):
    """Documents whose shingles resemble a benchmark item, within a similarity range."""
    hits = C.similarity_range(text_bits(t.benchmark, "item_id"), text_bits(t.documents, "doc_id"), 0.05, 0.9)
    return hits.select("query_id", "id", F.round("sim", 6).alias("sim"))


@query(
    "query_share_found",
    f"WITH {DOC_BITS}, {ITEM_BITS}, {range_sql('items', 'docs', 'sim >= 0.5', 'c::DOUBLE / len(a.bits)')} SELECT query_id, id, round(sim, 6) AS sim FROM hits",
)
def query_share_found(t):
    """Documents holding at least half of an item's shingles."""
    hits = C.similarity_range(
        text_bits(t.benchmark, "item_id"), text_bits(t.documents, "doc_id"), 0.5, 1.0, "euclid-sub"
    )
    return hits.select("query_id", "id", F.round("sim", 6).alias("sim"))


@query(
    "shingle_tanimoto_topn",
    f"WITH {DOC_BITS}, {ITEM_BITS}, {range_sql('items', 'docs', 'sim >= 0.02')}, r AS (SELECT query_id, id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM hits) SELECT query_id, id, round(sim, 6) AS sim, rank FROM r WHERE rank <= 5",
)
def shingle_tanimoto_topn(t):
    hits = C.similarity_range(text_bits(t.benchmark, "item_id"), text_bits(t.documents, "doc_id"), 0.02)
    best = M.top_n(hits, ["query_id"], 5, "sim", ["id"])
    return best.select("query_id", "id", F.round("sim", 6).alias("sim"), "rank")


@query(
    "document_near_copies",
    f"WITH {DOC_BITS}, {range_sql('docs', 'docs', 'sim >= 0.8')} SELECT query_id, id, round(sim, 6) AS sim FROM hits",
)
def document_near_copies(t):
    """Each text against all documents at similarity 0.8 and up."""
    hits = C.similar_pairs(text_bits(t.documents, "doc_id"), 0.8)
    return hits.select("query_id", "id", F.round("sim", 6).alias("sim"))


@query(
    "embedding_sign_range",
    f"WITH {SIGN_BITS}, {range_sql('signs', 'signs', 'sim >= 0.6 AND query_id <> k.id'.replace('k.id', 'id'))} SELECT query_id, id, round(sim, 6) AS sim FROM hits",
)
def embedding_sign_range(t):
    """The same search on a caller's own dense fingerprint: signs of embedding components."""
    rows = sign_rows(t)
    hits = dense.dense_range(rows, rows, 0.6)
    return hits.filter("query_id <> id").select("query_id", "id", F.round("sim", 6).alias("sim"))


@query(
    "embedding_topn",
    f"WITH {SIGN_BITS}, {range_sql('signs', 'signs', 'sim >= 0.55')}, r AS (SELECT query_id, id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM hits) SELECT query_id, id, round(sim, 6) AS sim, rank FROM r WHERE rank <= 3",
)
def embedding_topn(t):
    rows = sign_rows(t)
    best = dense.dense_topn(rows, rows, 3, 0.55)
    return best.select("query_id", "id", F.round("sim", 6).alias("sim"), "rank")


@query(
    "screen_superset",
    f"WITH {DOC_BITS}, {ITEM_BITS}, {range_sql('items', 'docs', 'sim >= 1', 'c::DOUBLE / len(a.bits)')} SELECT query_id, id FROM hits",
)
def screen_superset(t):
    """Documents whose bits cover all bits of a benchmark item."""
    return C.substructure_screen(text_bits(t.benchmark, "item_id"), text_bits(t.documents, "doc_id"))


@query(
    "exact_key_dupes",
    "SELECT md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS key, min(doc_id) AS rep, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
)
def exact_key_dupes(t):
    """Groups of texts equal up to white space."""
    key = F.md5(collapse_whitespace(F.col("text")))
    return C.exact_groups(t.documents, key, "doc_id").filter("n > 1")


@query(
    "exact_structure_search",
    f"""WITH {D.STRUCTURES_SQL}, keyed AS (SELECT mol_id, {KEY_SQL.replace('@S@', 'smiles')} AS key FROM structures),
    first AS (SELECT min(mol_id) AS query_id, key FROM keyed GROUP BY key)
    SELECT query_id, mol_id AS id FROM first JOIN keyed USING (key)""",
)
def exact_structure_search(t):
    """Structures equal to a query structure on their comparison key; each distinct query once."""
    # Keys are derived once and stored as digests; both sides of the join read them.
    rows = D.structures(t.documents).select("mol_id", F.unhex(F.md5(S.text_key(F.col("smiles")))).alias("text_key"))
    rows = materialise(rows, "structure-keys")
    wanted = C.exact_groups(rows, F.col("text_key"), "mol_id")
    q = wanted.select(F.col("rep").alias("id"), F.col("key").alias("text_key"))
    return C.exact_search(q, rows.select(F.col("mol_id").alias("id"), "text_key"), "text_key")


@query(
    "table_versions",
    "SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_size <> 7 AND p_partkey NOT IN (SELECT 2 * s_suppkey FROM supplier) UNION ALL SELECT 2 * s_suppkey, s_name, s_acctbal FROM supplier",
)
def table_versions(t):
    """New versions of a table: rows deleted by id, rows inserted, some over rows of their id."""
    table = t.part.select("p_partkey", "p_name", "p_retailprice")
    kept = C.without_ids(table, t.part.filter("p_size = 7"), "p_partkey")
    added = t.supplier.select((F.col("s_suppkey") * 2).alias("p_partkey"), F.col("s_name").alias("p_name"), F.col("s_acctbal").alias("p_retailprice"))
    return C.with_rows(kept, added, "p_partkey")


@query(
    "table_rows_by_id",
    "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)",
)
def table_rows_by_id(t):
    """Rows of a table fetched by a table of ids."""
    ids = t.lineitem.filter("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey"))
    return C.rows_by_id(t.part.select("p_partkey", "p_name"), ids, "p_partkey")


SIG_SQL = (
    DOC_BITS
    + """,
keyed AS (SELECT id, bits, md5(array_to_string(bits, ',')) AS k FROM docs),
reps AS (SELECT min(id) AS id, any_value(bits) AS bits FROM keyed GROUP BY k),
perms AS (SELECT i, 1 + ('0x' || substr(md5('a' || i), 1, 8))::BIGINT % 2147483647 AS a, ('0x' || substr(md5('b' || i), 1, 8))::BIGINT % 2147483647 AS b
  FROM (SELECT unnest(range(0, 125)) AS i)),
sig AS (SELECT id, i, min((bit * a + b) % 4294967291) AS s FROM (SELECT id, unnest(bits)::BIGINT AS bit FROM reps), perms GROUP BY id, i),
buckets AS (SELECT id, i // 5 AS band, string_agg(s::VARCHAR, ',' ORDER BY i) AS bucket FROM sig GROUP BY 1, 2),
hubs AS (SELECT band, bucket, min(id) AS hub FROM buckets GROUP BY 1, 2 HAVING count(*) > 1),
edges AS (SELECT DISTINCT id, hub FROM buckets JOIN hubs USING (band, bucket) WHERE id <> hub)"""
)
COMP_SQL = (
    SIG_SQL
    + """,
both_ways AS (SELECT id AS a, hub AS b FROM edges UNION SELECT hub, id FROM edges),
walk(v, r) AS (SELECT a, a FROM both_ways UNION SELECT g.b, w.r FROM walk w JOIN both_ways g ON g.a = w.v WHERE w.r < g.b),
closed AS (SELECT v, min(r) AS r FROM walk GROUP BY v),
clusters AS (SELECT d.id, coalesce(c.r, p.id) AS cluster FROM keyed d JOIN (SELECT min(id) AS id, k FROM keyed GROUP BY k) p USING (k) LEFT JOIN closed c ON c.v = p.id)"""
)


@query(
    "minhash_signatures",
    f"WITH {SIG_SQL} SELECT id, i // 25 AS part, sum(s)::BIGINT AS s_sum FROM sig GROUP BY 1, 2",
)
def minhash_signatures(t):
    """125 least hash values per distinct text, summed in fives of 25 for comparison."""
    slim, _ = C.fold_copies(text_bits(t.documents, "doc_id"))
    sig = C.minhash(slim, 125)
    parts = [
        F.struct(F.lit(p).cast("bigint").alias("part"), sum((F.col(f"s{p * 25 + i}") for i in range(1, 25)), F.col(f"s{p * 25}")).alias("s_sum"))
        for p in range(5)
    ]
    return sig.select("id", F.inline(F.array(*parts)))


@query("lsh_pairs", f"WITH {SIG_SQL} SELECT id, hub, 1.0::DOUBLE AS linked FROM edges")
def lsh_pairs(t):
    """Rows linked to the least row of a shared bucket; threshold 0.5 gives 25 bands of 5."""
    slim, _ = C.fold_copies(text_bits(t.documents, "doc_id"))
    return C.lsh_candidates(slim, 0.5).withColumn("linked", F.lit(1.0))


@query(
    "lsh_pairs_verified",
    f"WITH {SIG_SQL}, met AS (SELECT DISTINCT a.id, b.id AS other FROM buckets a JOIN buckets b USING (band, bucket) WHERE a.id < b.id), "
    "shared AS (SELECT m.id, other, len(list_intersect(a.bits, b.bits))::DOUBLE AS c, len(a.bits) + len(b.bits) AS n FROM met m JOIN reps a ON a.id = m.id JOIN reps b ON b.id = other) "
    "SELECT id, other, round(c / (n - c), 6) AS sim FROM shared WHERE c / (n - c) >= 0.5",
)
def lsh_pairs_verified(t):
    """All pairs of distinct texts that share a bucket and are similar."""
    slim, _ = C.fold_copies(text_bits(t.documents, "doc_id"))
    return C.verified_pairs(slim, 0.5).select("id", "other", F.round("sim", 6).alias("sim"))


@query("near_dupe_components", f"WITH RECURSIVE {COMP_SQL} SELECT id, cluster FROM clusters")
def near_dupe_components(t):
    return C.component_clusters(text_bits(t.documents, "doc_id"), 0.5)


@query("leader_clusters")
def leader_clusters(t):
    """Clusters as by adding documents one by one; checked against a plain loop in the tests."""
    return C.leader_clusters(text_bits(t.documents, "doc_id"), 0.5)


@query(
    "cluster_stats",
    f"WITH RECURSIVE {COMP_SQL} SELECT (SELECT count(*) FROM documents) AS total, count(*) AS processed, (SELECT count(*) FROM documents) - count(*) AS failed, count(DISTINCT cluster) AS clusters FROM clusters",
)
def cluster_stats(t):
    return C.cluster_stats(C.component_clusters(text_bits(t.documents, "doc_id"), 0.5), t.documents)


def balanced_sql(share):
    return f"""WITH RECURSIVE {COMP_SQL}, sizes AS (SELECT cluster, count(*) AS size FROM clusters GROUP BY 1),
    quotas AS (SELECT cluster, least(greatest(1, {share}), size)::BIGINT AS q FROM sizes),
    ranked AS (SELECT id, cluster, q, row_number() OVER (PARTITION BY cluster ORDER BY md5('42|' || id), id) AS r FROM clusters JOIN quotas USING (cluster)),
    drawn AS (SELECT id, cluster FROM ranked WHERE r <= q)
    SELECT id, cluster FROM drawn ORDER BY md5('42-cut|' || id), id LIMIT 950"""


@query("cluster_balanced_sample", balanced_sql("950 // (SELECT count(*) FROM sizes)"))
def cluster_balanced_sample(t):
    """Equal quota per near-duplicate cluster; never topped up."""
    clusters = C.component_clusters(text_bits(t.documents, "doc_id"), 0.5)
    return M.sample_balanced(clusters, ["cluster"], 950, ["id"], "equal", 42)


@query("sqrt_balanced_sample", balanced_sql("floor(950.0::DOUBLE * sqrt(size) / (SELECT sum(sqrt(size)) FROM sizes) + 1e-9)"))
def sqrt_balanced_sample(t):
    clusters = C.component_clusters(text_bits(t.documents, "doc_id"), 0.5)
    return M.sample_balanced(clusters, ["cluster"], 950, ["id"], "sqrt", 42)


@query("balanced_structure_sample")
def balanced_structure_sample(t):
    """Stratified pre-sample of ten times the wanted rows, clusters, balanced draw."""
    return J.balanced_structure_sample(D.structures(t.documents), 300)


@query(
    "structure_fingerprints",
    f"WITH {D.STRUCTURES_SQL}, toks AS (SELECT mol_id, {D.tokens_sql('smiles')} AS ws FROM structures) SELECT mol_id AS id, array_to_string(list_sort(list_distinct(list_transform(range(0, greatest(len(ws) - 3, 0) + 1), "
    "lambda i: (('0x' || substr(md5(array_to_string(ws[i + 1 : i + 3], ' ')), 1, 8))::BIGINT % 2048)::INTEGER))), ' ') AS bits FROM toks WHERE len(ws) > 0",
)
def structure_fingerprints(t):
    rows = J.structure_bits(D.structures(t.documents))
    return rows.filter(F.size("bits") > 0).select("id", F.array_join("bits", " ").alias("bits"))


