"""Scoring queries: predictions against truth, rewards, embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmine.functions import scalars as N
from docmine.functions import structures as S
from docmine.functions.binding import let
from docmine.operators import evaluation as E
from docmine.operators import sampling as M
from docmine.plans import derive as D
from docmine.plans.catalog.structures import KEY_SQL, QUICK
from docmine.plans.registry import query
from docmine.session import materialise

MODES = ("decoder", "graph", "postprocess")
# Truth: text keys of structures, bad when the hash says so; three predictions of each.
EVAL_SQL = (
    D.STRUCTURES_SQL
    + f""",
truth AS (SELECT source AS benchmark, mol_id AS image_id, {KEY_SQL.replace('@S@', 'smiles')} AS gt, h0 % 23 <> 0 AS ok, h0, smiles FROM structures),
preds AS (
  SELECT benchmark, image_id, ok, gt, 'decoder' AS mode, CASE WHEN h0 % 7 = 0 THEN NULL WHEN h0 % 7 = 1 THEN gt || 'C' ELSE gt END AS pred FROM truth
  UNION ALL SELECT benchmark, image_id, ok, gt, 'graph', CASE WHEN h0 % 5 = 0 THEN NULL WHEN h0 % 5 = 1 THEN replace(gt, 'N', 'O') ELSE gt END FROM truth
  UNION ALL SELECT benchmark, image_id, ok, gt, 'postprocess', CASE WHEN h0 % 11 = 0 THEN 'CC' ELSE gt END FROM truth),
scored AS (SELECT *, ok AND pred IS NOT NULL AND pred = gt AS match,
  CASE WHEN NOT ok OR pred IS NULL THEN 0.0 WHEN length(gt) = 0 AND length(pred) = 0 THEN 1.0 WHEN length(gt) = 0 OR length(pred) = 0 THEN 0.0
    ELSE 1.0::DOUBLE - levenshtein(pred, gt)::DOUBLE / greatest(length(pred), length(gt)) END AS sim FROM preds)"""
)


def scored(t):
    base = D.structures(t.documents).select(
        F.col("source").alias("benchmark"), F.col("mol_id").alias("image_id"), "h0", (F.col("h0") % 23 != 0).alias("ok"),
        S.text_key(F.col("smiles")).alias("gt"),
    )
    h = F.col("h0")

    def modes(gt):
        given = {
            "decoder": F.when(h % 7 == 0, None).when(h % 7 == 1, F.concat(gt, F.lit("C"))).otherwise(gt),
            "graph": F.when(h % 5 == 0, None).when(h % 5 == 1, F.replace(gt, F.lit("N"), F.lit("O"))).otherwise(gt),
            "postprocess": F.when(h % 11 == 0, "CC").otherwise(gt),
        }
        return F.array(*[F.struct(F.lit(m).alias("mode"), gt.alias("gt_smiles"), given[m].alias("pred_smiles")) for m in MODES])

    # Modes become rows: one structure, whose key is derived once, and three predictions.
    long = base.select("benchmark", "image_id", "ok", F.inline(let(F.col("gt"), modes)))
    return E.score_pairs(long, N.edit_similarity(F.col("pred_smiles"), F.col("gt_smiles")))


@query(
    "benchmark_scores",
    f"WITH {EVAL_SQL} SELECT benchmark, mode, round(count(*) FILTER (ok AND match) * 100.0::DOUBLE / count(*) FILTER (ok), 4) AS exact_match_acc, round(avg(sim) FILTER (ok), 6) AS avg_similarity, "
    "count(*) AS total, count(*) FILTER (ok) AS valid, count(*) FILTER (ok AND pred IS NULL) AS failed_predictions FROM scored GROUP BY 1, 2",
)
def benchmark_scores(t):
    m = E.benchmark_metrics(scored(t), ["benchmark", "mode"])
    return m.withColumns(
        {"exact_match_acc": F.round("exact_match_acc", 4), "avg_similarity": F.round("avg_similarity", 6)}
    )


@query(
    "metrics_by_mode",
    f"WITH {EVAL_SQL} SELECT benchmark, mode, round(avg(match::INTEGER), 6) AS exact_match_acc, round(avg(sim), 6) AS avg_similarity, count(*) FILTER (pred IS NULL) AS failed FROM scored WHERE ok GROUP BY 1, 2",
)
def metrics_by_mode(t):
    m = E.metrics_by_mode(scored(t))
    return m.withColumns({c: F.round(c, 6) for c in ("exact_match_acc", "avg_similarity")})


@query(
    "metrics_pivot",
    f"WITH {EVAL_SQL}, m AS (SELECT benchmark, mode, round(avg(match::INTEGER), 6) AS acc FROM scored WHERE ok GROUP BY 1, 2) SELECT benchmark, max(acc) FILTER (mode = 'decoder') AS decoder, max(acc) FILTER (mode = 'graph') AS graph, max(acc) FILTER (mode = 'postprocess') AS postprocess FROM m GROUP BY 1",
)
def metrics_pivot(t):
    """Benchmarks by mode in one table."""
    m = E.metrics_by_mode(scored(t)).withColumn("acc", F.round("exact_match_acc", 6))
    return E.summary_table(m, "benchmark", "mode", "acc", MODES)


@query(
    "event_pivot",
    "SELECT event_type, count(*) FILTER (dow = 0) AS \"0\", count(*) FILTER (dow = 1) AS \"1\", count(*) FILTER (dow = 2) AS \"2\" FROM (SELECT event_type, (event_id % 3)::INTEGER AS dow FROM events) GROUP BY 1",
)
def event_pivot(t):
    slots = t.events.select("event_type", (F.col("event_id") % 3).cast("int").alias("slot"))
    counts = slots.groupBy("event_type", "slot").agg(F.count(F.lit(1)).alias("n"))
    return E.summary_table(counts, "event_type", "slot", "n", [0, 1, 2])


@query(
    "truth_vs_prediction",
    "WITH p AS (SELECT d.source AS benchmark, d.doc_id, l.quality, d.doc_id % 9 <> 0 AS ok FROM documents d LEFT JOIN labels l USING (doc_id)), "
    "s AS (SELECT *, ok AND quality IS NOT NULL AND quality = 1 AS match FROM p) SELECT benchmark, round(count(*) FILTER (ok AND match) * 100.0::DOUBLE / greatest(count(*) FILTER (ok), 1), 4) AS exact_match_acc, "
    "round(coalesce(avg(match::INTEGER) FILTER (ok), 0), 6) AS avg_similarity, count(*) AS total, count(*) FILTER (ok) AS valid, count(*) FILTER (ok AND quality IS NULL) AS failed_predictions FROM s GROUP BY 1",
)
def truth_vs_prediction(t):
    """Documents as truth, labels as predictions, joined by id; unlabelled ones failed."""
    truth = t.documents.select(
        F.col("source").alias("benchmark"), "doc_id", F.lit("1").alias("smiles"), (F.col("doc_id") % 9 != 0).alias("ok")
    )
    pred = t.labels.select("doc_id", F.col("quality").cast("string").alias("smiles"))
    pairs = E.pair_predictions(truth, pred, ["doc_id"])
    same = F.when(F.col("pred_smiles") == F.col("gt_smiles"), 1.0).otherwise(0.0)
    m = E.benchmark_metrics(E.score_pairs(pairs, same))
    return m.withColumns(
        {"exact_match_acc": F.round("exact_match_acc", 4), "avg_similarity": F.round("avg_similarity", 6)}
    )


# Truth and predictions as two tables. Images exist for labelled documents; predictions are
# missing, altered, unreadable or given twice by their own hash.
TWO_TABLES_SQL = (
    D.VALID_SQL
    + f""",
images AS (SELECT mol_id FROM structures WHERE doc_id IN (SELECT doc_id FROM labels)),
given AS (
  SELECT source AS benchmark, mol_id AS image_id, 'decoder' AS mode, CASE WHEN h0 % 7 = 1 THEN smiles || 'C' ELSE smiles END AS p FROM structures WHERE h0 % 13 > 0
  UNION ALL SELECT source, mol_id, 'graph', CASE WHEN h0 % 5 = 0 THEN smiles || '(' ELSE replace(smiles, 'N', 'O') END FROM structures
  UNION ALL SELECT source, mol_id, 'postprocess', smiles FROM structures WHERE h0 % 11 > 0
  UNION ALL SELECT source, mol_id, 'postprocess', 'CC' FROM structures WHERE h0 % 17 = 0),
preds AS (SELECT benchmark, image_id, g.mode, min({KEY_SQL.replace('@S@', 'p')}) AS pred FROM given g
  WHERE (CASE g.mode WHEN 'graph' THEN NOT suffix(p, '(') ELSE true END) AND (p = 'CC' OR image_id IN (SELECT mol_id FROM valid)) GROUP BY 1, 2, 3),
asked AS (SELECT source AS benchmark, mol_id AS image_id, m.mode, mol_id IN (SELECT mol_id FROM valid) AS ok, {KEY_SQL.replace('@S@', 'smiles')} AS gt
  FROM structures, (SELECT unnest(['decoder', 'graph', 'postprocess']) AS mode) m WHERE mol_id IN (SELECT mol_id FROM images)),
scored AS (SELECT a.*, pred, ok AND pred IS NOT NULL AND pred = gt AS match,
  CASE WHEN NOT ok OR pred IS NULL THEN 0.0 WHEN length(gt) = 0 AND length(pred) = 0 THEN 1.0 WHEN length(gt) = 0 OR length(pred) = 0 THEN 0.0
    ELSE 1.0::DOUBLE - levenshtein(pred, gt)::DOUBLE / greatest(length(pred), length(gt)) END AS sim
  FROM asked a LEFT JOIN preds p ON a.benchmark = p.benchmark AND a.image_id = p.image_id AND a.mode = p.mode)"""
)


def two_tables(t):
    # Derived once: truth, images and four kinds of predictions read the stored rows.
    rows = materialise(
        D.structures(t.documents).select(F.col("source").alias("benchmark"), F.col("mol_id").alias("image_id"), "doc_id", "smiles", "h0"),
        "structures",
    )
    s, h = F.col("smiles"), F.col("h0")
    part = lambda mode, p, kept=F.lit(True): rows.filter(kept).select("benchmark", "image_id", F.lit(mode).alias("mode"), p.alias("smiles"))
    given = (
        part("decoder", F.when(h % 7 == 1, F.concat(s, F.lit("C"))).otherwise(s), h % 13 > 0)
        .unionByName(part("graph", F.when(h % 5 == 0, F.concat(s, F.lit("("))).otherwise(F.replace(s, F.lit("N"), F.lit("O")))))
        .unionByName(part("postprocess", s, h % 11 > 0)).unionByName(part("postprocess", F.lit("CC"), h % 17 == 0))
    )
    images = rows.join(t.labels.select("doc_id"), "doc_id", "left_semi")
    truth = rows.select("benchmark", "image_id", "smiles")
    return E.evaluate(truth, images, given, MODES, S.text_key, S.is_valid_structure, N.edit_similarity)


@query(
    "evaluated_benchmarks",
    f"WITH RECURSIVE {TWO_TABLES_SQL} SELECT benchmark, mode, round(coalesce(count(*) FILTER (ok AND match) * 100.0::DOUBLE / nullif(count(*) FILTER (ok), 0), 0), 4) AS exact_match_acc, "
    "round(coalesce(avg(sim) FILTER (ok), 0), 6) AS avg_similarity, count(*) AS total, count(*) FILTER (ok) AS valid, count(*) FILTER (ok AND pred IS NULL) AS failed_predictions FROM scored GROUP BY 1, 2",
)
def evaluated_benchmarks(t):
    """Truth and predictions joined from two tables, over images that exist."""
    m = E.benchmark_metrics(two_tables(t), ["benchmark", "mode"])
    return m.withColumns({"exact_match_acc": F.round("exact_match_acc", 4), "avg_similarity": F.round("avg_similarity", 6)})


@query(
    "evaluation_records",
    f"WITH RECURSIVE {TWO_TABLES_SQL} SELECT benchmark, image_id, gt AS gt_smiles, pred AS pred_smiles, round(sim, 6) AS sim, "
    "CASE WHEN NOT ok THEN 'bad_truth' WHEN pred IS NULL THEN 'failed' WHEN match THEN 'match' ELSE 'differs' END AS status FROM scored WHERE mode = 'postprocess'",
)
def evaluation_records(t):
    return E.evaluation_records(two_tables(t), "postprocess").withColumn("sim", F.round("sim", 6))


SAMPLES_SQL = """
samples AS (SELECT l_orderkey // 5000 AS batch, CASE WHEN l_orderkey % 3 = 0 THEN l_orderkey * 10 + l_linenumber ELSE l_orderkey END AS image_id, l_orderkey, l_linenumber,
  CASE WHEN l_returnflag <> 'R' THEN l_discount * 10 + l_tax END AS distance FROM lineitem),
rewarded AS (SELECT *, CASE WHEN distance IS NULL THEN -2.0::DOUBLE ELSE -distance::DOUBLE END AS reward FROM samples),
means AS (SELECT batch, row_number() OVER (ORDER BY batch) AS step, coalesce(avg(reward) FILTER (distance IS NOT NULL), -2.0) AS m FROM rewarded GROUP BY batch),
runs AS (SELECT step, m AS b FROM means WHERE step = 1 UNION ALL SELECT means.step, 0.9::DOUBLE * b + 0.1::DOUBLE * m FROM runs JOIN means ON means.step = runs.step + 1),
based AS (SELECT means.batch, b FROM means LEFT JOIN runs ON runs.step = means.step - 1),
grouped AS (SELECT batch, image_id, count(*) AS n, avg(reward) AS mu, stddev_samp(reward) AS sd FROM rewarded GROUP BY 1, 2)"""


@query(
    "sample_advantages",
    f"WITH RECURSIVE {SAMPLES_SQL} SELECT batch, count(*) AS n, count(*) FILTER (n < 2) AS n_lone, count(*) FILTER (distance IS NULL) AS n_invalid, round(sum(reward), 4) AS reward, "
    "round(sum(abs(CASE WHEN n < 2 THEN reward - coalesce(b, reward) WHEN sd > 1e-8 THEN (reward - mu) / sd ELSE reward - mu END)), 4) AS advantage "
    "FROM rewarded JOIN grouped USING (batch, image_id) JOIN based USING (batch) GROUP BY batch",
)
def sample_advantages(t):
    """Sampled candidates of an order, some of them invalid, and every third order's lone ones."""
    order = F.col("l_orderkey")
    rows = t.lineitem.select(
        F.floor(order / 5000).alias("batch"), F.when(order % 3 == 0, order * 10 + F.col("l_linenumber")).otherwise(order).alias("image_id"),
        F.when(F.col("l_returnflag") != "R", (F.col("l_discount") * 10 + F.col("l_tax")).cast("double")).alias("distance"),
    )
    lone = E.with_group_stats(E.sample_advantages(rows, "batch", "image_id"), ["batch", "image_id"], k=F.count(F.lit(1)))
    return lone.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") < 2).alias("n_lone"), F.count_if(F.col("distance").isNull()).alias("n_invalid"),
        F.round(F.sum("reward"), 4).alias("reward"), F.round(F.sum(F.abs("advantage")), 4).alias("advantage"),
    )


@query(
    "mean_group_risk",
    f"WITH {D.CANDIDATES_SQL}, costs AS (SELECT image_id, log_prob * 0.1 AS l, 1 - (0.1 * valid::INTEGER + 0.5 * CASE WHEN valid THEN sim ELSE 0 END + 0.4 * exact::INTEGER) AS c FROM candidates), "
    "m AS (SELECT image_id, max(l) AS mx FROM costs GROUP BY 1), risks AS (SELECT image_id, sum(exp(l - mx) * c) / sum(exp(l - mx)) AS risk FROM costs JOIN m USING (image_id) GROUP BY 1) "
    "SELECT round(avg(risk), 6) AS risk, count(*) AS n_groups FROM risks",
)
def mean_group_risk(t):
    """Expected cost of an order's candidates, averaged over the orders."""
    rows = E.score_candidates(D.candidates(t.lineitem))
    return E.mean_risk(rows, "image_id", F.col("cost"), alpha=0.1).withColumn("risk", F.round("risk", 6))


@query(
    "edit_similarity_pairs",
    f"WITH {D.STRUCTURES_SQL} SELECT mol_id, round(1.0 - levenshtein(smiles, q)::DOUBLE / greatest(length(smiles), length(q)), 6) AS sim FROM (SELECT mol_id, smiles, {QUICK} AS q FROM structures)",
)
def edit_similarity_pairs(t):
    """Structure text before and after label normalisation."""
    smiles = F.col("smiles")
    return D.structures(t.documents).select("mol_id", "smiles", S.quick_normalise(smiles).alias("q")).select(
        "mol_id", F.round(N.edit_similarity(smiles, F.col("q")), 6).alias("sim")
    )


REWARD_SQL = (
    D.CANDIDATES_SQL
    + """,
rewards AS (SELECT image_id, sample_key, log_prob, valid, exact, CASE WHEN valid THEN sim ELSE 0 END AS sim,
  0.1 * valid::INTEGER + 0.5 * CASE WHEN valid THEN sim ELSE 0 END + 0.4 * exact::INTEGER AS reward FROM candidates)"""
)


@query(
    "group_advantage",
    f"WITH {REWARD_SQL}, g AS (SELECT image_id, count(*) AS n, avg(reward) AS m, stddev_samp(reward) AS s FROM rewards GROUP BY 1) SELECT image_id, count(*) AS n, round(sum(CASE WHEN n < 2 THEN reward - 0.5 WHEN s > 1e-8 THEN (reward - m) / s ELSE reward - m END * reward) + 3.7e-10, 6) AS weighted "
    "FROM rewards JOIN g USING (image_id) GROUP BY 1",
)
def group_advantage(t):
    """Advantage of each candidate in its group, summed with the reward as weight."""
    rows = E.score_candidates(D.candidates(t.lineitem))
    adv = E.group_advantage(rows, "image_id", F.col("reward"), 0.5)
    return adv.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(F.col("advantage") * F.col("reward")) + 3.7e-10, 6).alias("weighted"),
    )


@query(
    "group_softmax_risk",
    f"WITH {REWARD_SQL}, m AS (SELECT image_id, max(log_prob * 0.1) AS mx FROM rewards GROUP BY 1) SELECT image_id, round(sum(exp(log_prob * 0.1 - mx) * (1 - reward)) / sum(exp(log_prob * 0.1 - mx)) + 3.7e-10, 6) AS risk FROM rewards JOIN m USING (image_id) GROUP BY 1",
)
def group_softmax_risk(t):
    rows = E.score_candidates(D.candidates(t.lineitem))
    risk = E.expected_risk(rows, "image_id", F.col("cost"), alpha=0.1)
    return risk.withColumn("risk", F.round(F.col("risk") + 3.7e-10, 6))


@query(
    "reward_summary",
    f"WITH {REWARD_SQL} SELECT round(avg(reward), 6) AS mean_reward, round(avg(1 - reward), 6) AS mean_cost, round(avg(log_prob), 6) AS mean_log_prob, round(avg(sim), 6) AS mean_similarity, count(*) FILTER (exact) AS exact_matches, count(*) FILTER (valid) AS valid_count FROM rewards",
)
def reward_summary(t):
    s = E.reward_summary(E.score_candidates(D.candidates(t.lineitem)))
    return s.withColumns({c: F.round(c, 6) for c in ("mean_reward", "mean_cost", "mean_log_prob", "mean_similarity")})


# Neighbouring turns of a conversation stand for atom pairs; logits are hashed.
LOGIT_SQL = """
links AS (SELECT DISTINCT conv_id AS sample_id, turn AS i, turn + 1 AS j FROM conversations),
logits AS (SELECT sample_id, i, j, k, ('0x' || substr(md5(concat_ws(',', sample_id, i, j, k)), 1, 4))::BIGINT / 10000.0::DOUBLE AS logit
  FROM (SELECT sample_id, i, j FROM links UNION ALL SELECT sample_id, j, i FROM links) b, (SELECT unnest(range(0, 7))::INTEGER AS k) c),
soft AS (SELECT sample_id, i, j, k, exp(logit - max(logit) OVER w) / sum(exp(logit)) OVER w * exp(max(logit) OVER w) AS p FROM logits WINDOW w AS (PARTITION BY sample_id, i, j))"""


def soft(t):
    links = t.conversations.select("conv_id", "turn").distinct()
    u, v = F.col("turn"), F.col("turn") + 1
    ends = F.explode(F.array(F.struct(u.alias("i"), v.alias("j")), F.struct(v.alias("i"), u.alias("j"))))
    pairs = links.select(F.col("conv_id").alias("sample_id"), ends.alias("e"))
    cells = pairs.select("sample_id", "e.i", "e.j", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("k"))
    logit = F.conv(F.substring(F.md5(F.concat_ws(",", "sample_id", "i", "j", "k")), 1, 4), 16, 10).cast("bigint") / 10000.0
    return E.class_softmax(cells.withColumn("logit", logit), ["sample_id", "i", "j"])


@query("class_softmax", f"WITH {LOGIT_SQL} SELECT k, count(*) AS n, round(avg(p), 6) AS p, round(max(p), 6) AS peak FROM soft GROUP BY 1")
def class_softmax(t):
    """Class probabilities per atom pair, summed up per class."""
    return soft(t).groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("p"), F.round(F.max("p"), 6).alias("peak")
    )


@query(
    "symmetric_bond_classes",
    f"WITH {LOGIT_SQL}, m AS (SELECT a.sample_id, a.i, a.j, a.k, (a.p + b.p) / 2 AS p FROM soft a JOIN soft b ON a.sample_id = b.sample_id AND a.i = b.j AND a.j = b.i AND b.k = CASE a.k WHEN 5 THEN 6 WHEN 6 THEN 5 ELSE a.k END) "
    ", w AS (SELECT sample_id, i, j, arg_max(k, p) AS code, max(p) AS p FROM m GROUP BY 1, 2, 3) SELECT code, count(*) AS n, sum(i)::BIGINT AS i_sum, round(avg(p), 6) AS p FROM w GROUP BY 1",
)
def symmetric_bond_classes(t):
    """Bond classes after averaging both directions, summed up per class."""
    return E.symmetrise_edges(soft(t)).groupBy("code").agg(
        F.count(F.lit(1)).alias("n"), F.sum("i").alias("i_sum"), F.round(F.avg("p"), 6).alias("p")
    )


TRIPLET_SQL = """
ranked AS (SELECT vec_id AS id, label, embedding,
  row_number() OVER (PARTITION BY label ORDER BY md5('42-key|' || vec_id), vec_id) AS r, count(*) OVER (PARTITION BY label) AS n,
  row_number() OVER (ORDER BY md5('42-all|' || vec_id), vec_id) AS g, count(*) OVER () AS total,
  ('0x' || substr(md5('42-draw|' || vec_id), 1, 8))::BIGINT AS draw FROM embeddings),
trip AS (SELECT a.id AS anchor, p.id AS positive, a.draw % 10000 < 3000 AND a.n > 2 AS hard, CASE WHEN a.draw % 10000 < 3000 AND a.n > 2 THEN h.id ELSE e.id END AS negative
  FROM ranked a JOIN ranked p ON p.label = a.label AND p.r = a.r % a.n + 1 JOIN ranked h ON h.label = a.label AND h.r = (a.r + 1) % a.n + 1
  JOIN ranked e ON e.g = (a.g - 1 + (a.draw // 10000) % (a.total - 1) + 1) % a.total + 1 WHERE a.n > 1),
dist AS (SELECT anchor, positive, negative, hard,
  sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - p.embedding[i]::DOUBLE) ** 2))) AS d_pos,
  sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE) ** 2))) AS d_neg
  FROM trip JOIN ranked a ON a.id = anchor JOIN ranked p ON p.id = positive JOIN ranked q ON q.id = negative)"""


def distances(t):
    trip = M.sample_triplets(t.embeddings, "vec_id", "label", 0.3, 42)
    return E.triplet_distances(trip, t.embeddings, "vec_id", "embedding")


@query("sampled_triplets", f"WITH {TRIPLET_SQL} SELECT anchor, positive, negative, hard FROM trip")
def sampled_triplets(t):
    return M.sample_triplets(t.embeddings, "vec_id", "label", 0.3, 42)


@query("triplet_loss", f"WITH {TRIPLET_SQL} SELECT round(avg(greatest(d_pos - d_neg + 0.2, 0)), 6) AS loss, count(*) AS n FROM dist")
def triplet_loss(t):
    return E.triplet_loss(distances(t), 0.2).withColumn("loss", F.round("loss", 6))


@query("embedding_same_flag", f"WITH {TRIPLET_SQL} SELECT anchor, positive, round(d_pos, 6) AS d_pos, d_pos < 1.2 AS same FROM dist")
def embedding_same_flag(t):
    """Distance of each anchor to its positive and the same/different call."""
    return distances(t).select("anchor", "positive", F.round("d_pos", 6).alias("d_pos"), (F.col("d_pos") < 1.2).alias("same"))


@query(
    "distance_stats",
    f"WITH {TRIPLET_SQL} SELECT hard, round(coalesce(min(d_neg) FILTER (d_neg < 1.45), 2), 6) AS min_distance, round(coalesce(avg(d_neg) FILTER (d_neg < 1.45), 2), 6) AS avg_distance, round(coalesce(max(d_neg) FILTER (d_neg < 1.45), 2), 6) AS max_distance, "
    "round(count(DISTINCT anchor % 50) FILTER (d_neg < 1.45) / count(DISTINCT anchor % 50), 6) AS valid_ratio, round(1 - count(DISTINCT anchor % 50) FILTER (d_neg < 1.45) / count(DISTINCT anchor % 50), 6) AS invalid_ratio FROM dist GROUP BY 1",
)
def distance_stats(t):
    images = distances(t).withColumn("image", F.col("anchor") % 50)
    s = E.distance_stats(images, F.col("d_neg"), F.col("d_neg") < 1.45, ["hard"], "image")
    return s.select("hard", *[F.round(c, 6).alias(c) for c in s.columns if c != "hard"])


@query(
    "cosine_to_positive",
    f"WITH {TRIPLET_SQL} SELECT anchor, round(least(1, greatest(0, list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * p.embedding[i]::DOUBLE)) / "
    "(sqrt(list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE ** 2))) * sqrt(list_sum(list_transform(range(1, 65), lambda i: p.embedding[i]::DOUBLE ** 2)))))), 6) AS cosine FROM trip JOIN ranked a ON a.id = anchor JOIN ranked p ON p.id = positive",
)
def cosine_to_positive(t):
    trip = M.sample_triplets(t.embeddings, "vec_id", "label", 0.3, 42)
    vec = t.embeddings.select("vec_id", "embedding")
    both = trip.join(vec.select(F.col("vec_id").alias("anchor"), F.col("embedding").alias("a")), "anchor").join(
        vec.select(F.col("vec_id").alias("positive"), F.col("embedding").alias("b")), "positive"
    )
    return both.select("anchor", F.round(N.cosine_clamped(F.col("a"), F.col("b")), 6).alias("cosine"))


@query(
    "normalised_vectors",
    "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE ** 2)))))), 5) AS l1 FROM embeddings",
)
def normalised_vectors(t):
    unit = N.l2_normalise(F.col("embedding"))
    total = F.aggregate(unit, F.lit(0.0), lambda acc, x: acc + F.abs(x))
    return t.embeddings.select("vec_id", F.round(total, 5).alias("l1"))


@query(
    "mode_tanimoto",
    f"WITH {EVAL_SQL}, b AS (SELECT mode, {D.tokens_sql('gt')} AS x, {D.tokens_sql('pred')} AS y FROM preds WHERE ok) SELECT mode, count(*) AS n, "
    "round(avg(CASE WHEN y IS NULL OR len(list_distinct(x || y)) = 0 THEN 0 ELSE len(list_intersect(x, y))::DOUBLE / len(list_distinct(x || y)) END), 6) AS sim FROM b GROUP BY 1",
)
def mode_tanimoto(t):
    """Set similarity of the token sets, null predictions at 0."""
    gt, pred = F.col("gt_smiles"), F.col("pred_smiles")
    sets = F.struct(F.array_distinct(S.tokenise(gt)).alias("x"), F.array_distinct(S.tokenise(pred)).alias("y"))
    # Most predictions are the truth: their sets are equal and need not be made.
    sim = (
        F.when(pred.isNull(), 0.0)
        .when(gt == pred, F.when(gt.rlike(S.TOKENS), 1.0).otherwise(0.0))
        .otherwise(let(sets, lambda s: N.tanimoto(s["x"], s["y"])))
    )
    rows = scored(t).filter("ok").select("mode", sim.alias("sim"))
    return rows.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("sim"), 6).alias("sim"))
