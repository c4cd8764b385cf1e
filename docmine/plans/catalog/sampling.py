"""Seeded sampling, strata, ordered scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmine.functions import scalars as N
from docmine.functions import text as T
from docmine.operators import ordering as O
from docmine.operators import sampling as S
from docmine.plans import derive as D
from docmine.plans.registry import query


@query(
    "seeded_sample",
    "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 500",
)
def seeded_sample(t):
    return S.sample_n(t.orders.select("o_orderkey", "o_custkey"), 500, ["o_orderkey"], 42)


@query(
    "control_group",
    "WITH m AS (SELECT count(*) AS k FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) "
    "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('2026|' || doc_id), doc_id) AS r FROM documents) WHERE r <= (SELECT k FROM m)",
)
def control_group(t):
    """As many random documents as there are labelled ones."""
    from docmine.operators.pages import keep_allowed

    docs = t.documents.select("doc_id")
    wanted = keep_allowed(docs, t.labels, "doc_id").agg(F.count(F.lit(1))).scalar()
    ranked = O.rank_by_hash(docs, [], ["doc_id"], 2026, "rank")
    return ranked.filter(F.col("rank") <= wanted).select("doc_id")


@query(
    "train_val_split",
    "SELECT o_orderkey, CASE WHEN r <= least(greatest(1, floor(n * (1 - 0.1))), n - 1) THEN 'train' ELSE 'val' END AS split FROM "
    "(SELECT o_orderkey, row_number() OVER (ORDER BY md5('7|' || o_orderkey), o_orderkey) AS r, count(*) OVER () AS n FROM orders)",
)
def train_val_split(t):
    return S.train_val_split(t.orders.select("o_orderkey"), ["o_orderkey"], 0.1, 7)


@query(
    "take_per_source",
    "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || doc_id), doc_id) AS r FROM documents) WHERE r <= 5",
)
def take_per_source(t):
    return S.take_per_group(t.documents.select("doc_id", "source"), ["source"], 5, ["doc_id"], 42)


BIN_SQL = (
    "((CASE WHEN q >= 0 THEN 1 ELSE 0 END + CASE WHEN q >= 10 THEN 1 ELSE 0 END + CASE WHEN q >= 20 THEN 1 ELSE 0 END "
    "+ CASE WHEN q >= 30 THEN 1 ELSE 0 END + CASE WHEN q >= 50 THEN 1 ELSE 0 END) - 1)::INTEGER AS q_bin, "
    "((CASE WHEN d >= 0 THEN 1 ELSE 0 END + CASE WHEN d >= 3 THEN 1 ELSE 0 END + CASE WHEN d >= 8 THEN 1 ELSE 0 END) - 1)::INTEGER AS d_bin"
)
STRATA_SQL = (
    f"strata AS (SELECT sample_key, {BIN_SQL} FROM (SELECT {D.LINE_KEY_SQL} AS sample_key, l_quantity AS q, round(l_discount * 100) AS d FROM lineitem))"
)
BINS = {"q": [0, 10, 20, 30, 50, float("inf")], "d": [0, 3, 8, float("inf")]}


def strata(t):
    props = t.lineitem.select(
        D.line_key(t.lineitem).alias("sample_key"),
        F.col("l_quantity").alias("q"),
        F.round(F.col("l_discount") * 100).alias("d"),
    )
    return S.add_strata(props, BINS)


@query(
    "stratum_sizes",
    f"WITH {STRATA_SQL} SELECT q_bin, d_bin, count(*) AS size FROM strata GROUP BY 1, 2",
)
def stratum_sizes(t):
    rows, keys = strata(t)
    return S.group_sizes(rows, keys)


QUOTA_SQL = """
sizes AS (SELECT q_bin, d_bin, count(*) AS size FROM strata GROUP BY 1, 2),
base AS (SELECT *, least(greatest(1, {n} // (SELECT count(*) FROM sizes)), size) AS q0 FROM sizes),
walked AS (SELECT *, {n} - sum(q0) OVER () AS short,
  coalesce(sum(size - q0) OVER (ORDER BY size DESC, q_bin, d_bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM base),
quotas AS (SELECT q_bin, d_bin, size, (q0 + greatest(0, least(size - q0, short - before)))::BIGINT AS quota FROM walked)"""


@query(
    "waterfill_quotas",
    f"WITH {STRATA_SQL}, {QUOTA_SQL.format(n=40000)} SELECT * FROM quotas",
)
def waterfill_quotas(t):
    rows, keys = strata(t)
    return S.waterfill(S.group_sizes(rows, keys), keys, 40000)


def stratified_sql(n):
    return f"""WITH {STRATA_SQL}, {QUOTA_SQL.format(n=n)},
    ranked AS (SELECT s.sample_key, s.q_bin, s.d_bin, quota, row_number() OVER (PARTITION BY s.q_bin, s.d_bin ORDER BY md5('42|' || sample_key), sample_key) AS r
      FROM strata s JOIN quotas q ON s.q_bin = q.q_bin AND s.d_bin = q.d_bin)
    SELECT sample_key, q_bin, d_bin FROM ranked WHERE r <= quota ORDER BY md5('42-cut|' || sample_key), sample_key LIMIT {n}"""


@query("stratified_sample", stratified_sql(9000))
def stratified_sample(t):
    rows, keys = strata(t)
    return S.sample_stratified(rows, keys, 9000, ["sample_key"], 42).select("sample_key", *keys)


@query("waterfill_sample", stratified_sql(40000))
def waterfill_sample(t):
    """More wanted than equal quotas give: the largest strata fill the rest."""
    rows, keys = strata(t)
    return S.sample_stratified(rows, keys, 40000, ["sample_key"], 42).select("sample_key", *keys)


@query(
    "digitised_lengths",
    "SELECT bin, count(*) AS n FROM (SELECT ((n_chars >= 0)::INT + (n_chars >= 500)::INT + (n_chars >= 2000)::INT + (n_chars >= 10000)::INT - 1)::INTEGER AS bin FROM documents) GROUP BY 1",
)
def digitised_lengths(t):
    edges = [0, 500, 2000, 10000, float("inf")]
    return t.documents.groupBy(N.digitise(F.col("n_chars"), edges).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "quantise_bins",
    "SELECT x_bin, count(*) AS n FROM (SELECT greatest(0, least(63, floor(least(greatest(l_extendedprice, 0), 95000 - 1) / 95000 * 64)))::INTEGER AS x_bin FROM lineitem) GROUP BY 1",
)
def quantise_bins(t):
    return t.lineitem.groupBy(N.quantise(F.col("l_extendedprice"), 95000, 64).alias("x_bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "hard_probability_ramp",
    "SELECT turn, round(0.1 + (0.8 - 0.1) * least(turn, 4) / 4, 6) AS p, count(*) AS n FROM conversations GROUP BY turn",
)
def hard_probability_ramp(t):
    """Linear ramp over steps, flat after half of ten epochs."""
    length = N.ramp_length(10)
    return t.conversations.groupBy("turn").agg(F.count(F.lit(1)).alias("n")).select(
        "turn", F.round(N.ramp(F.col("turn"), 0.1, 0.8, length), 6).alias("p"), "n"
    )


@query(
    "time_islands",
    "WITH m AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 43200000000 THEN 1 ELSE 0 END AS b FROM events), "
    "i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM m) "
    "SELECT user_id, island::INTEGER AS island, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM i GROUP BY 1, 2",
)
def time_islands(t):
    """Runs of a user's events without a twelve-hour gap; hours are the buckets."""
    events = t.events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    islands = O.split_islands(
        events, ["user_id"], F.floor(F.col("us") / 3600000000), ["us", "event_id"],
        F.col("us"), F.col("us"), 43200000000,
    )
    return islands.groupBy("user_id", "island").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")
    )


@query(
    "running_baseline",
    "WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events), "
    "r AS (SELECT user_id, event_id, step, value AS b FROM e WHERE step = 1 UNION ALL "
    "SELECT e.user_id, e.event_id, e.step, 0.9 * r.b + 0.1 * e.value FROM r JOIN e ON e.user_id = r.user_id AND e.step = r.step + 1) "
    "SELECT user_id, event_id, step, round(b + 3.7e-10, 6) AS baseline FROM r",
)
def running_baseline(t):
    """Moving baseline of a user's values after each event."""
    events = t.events.select(
        "user_id", "event_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")
    )
    run = O.ema_baseline(
        events, ["user_id"], {"hour": F.floor(F.col("us") / 3600000000)}, ["us", "event_id"], "value"
    )
    return run.select("user_id", "event_id", "step", F.round(F.col("baseline") + 3.7e-10, 6).alias("baseline"))


@query(
    "stratified_structures",
    f"""WITH RECURSIVE {D.VALID_SQL},
    counted AS (SELECT mol_id,
      len(list_filter({D.atom_tokens_sql('smiles')}, lambda t: NOT regexp_matches(t, '^\\[\\d*H[+-]?\\d*\\]$'))) AS a,
      len(list_filter({D.tokens_sql('smiles')}, lambda t: regexp_matches(t, '^(%\\d\\d|\\d)$'))) // 2 AS k FROM structures WHERE mol_id IN (SELECT mol_id FROM valid)),
    binned AS (SELECT mol_id, ((a >= 0)::INT + (a >= 10)::INT + (a >= 20)::INT + (a >= 30)::INT + (a >= 50)::INT + (a >= 100)::INT - 1)::INTEGER AS num_atoms_bin,
      ((k >= 0)::INT + (k >= 1)::INT + (k >= 2)::INT + (k >= 3)::INT + (k >= 5)::INT - 1)::INTEGER AS num_rings_bin FROM counted),
    sizes AS (SELECT num_atoms_bin, num_rings_bin, count(*) AS size FROM binned GROUP BY 1, 2),
    base AS (SELECT *, least(greatest(1, 2000 // (SELECT count(*) FROM sizes)), size) AS q0 FROM sizes),
    walked AS (SELECT *, 2000 - sum(q0) OVER () AS short, coalesce(sum(size - q0) OVER (ORDER BY size DESC, num_atoms_bin, num_rings_bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM base),
    quotas AS (SELECT num_atoms_bin, num_rings_bin, q0 + greatest(0, least(size - q0, short - before)) AS quota FROM walked),
    ranked AS (SELECT mol_id, num_atoms_bin, num_rings_bin, quota, row_number() OVER (PARTITION BY num_atoms_bin, num_rings_bin ORDER BY md5('42|' || mol_id), mol_id) AS r FROM binned JOIN quotas USING (num_atoms_bin, num_rings_bin))
    SELECT mol_id, num_atoms_bin, num_rings_bin FROM ranked WHERE r <= quota ORDER BY md5('42-cut|' || mol_id), mol_id LIMIT 2000""",
)
def stratified_structures(t):
    """Readable structures stratified by heavy atoms and rings, the default bins."""
    from docmine.plans.jobs import structure_strata

    rows, keys = structure_strata(D.structures(t.documents))
    return S.sample_stratified(rows, keys, 2000, ["mol_id"], 42).select("mol_id", *keys)


@query(
    "hash_order_check",
    "SELECT doc_id, md5('9|' || doc_id) AS h FROM documents",
)
def hash_order_check(t):
    return t.documents.select("doc_id", T.hash_order(9, F.col("doc_id")).alias("h"))
