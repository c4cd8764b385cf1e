"""Scoring predictions against ground truth, and candidate rewards."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmine.functions import scalars as N
from docmine.operators.ordering import ema_baseline, with_group_stats

INVALID_DISTANCE = 2.0


def pair_predictions(truth: DataFrame, predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Truth rows with their prediction by id; a missing one stays null."""
    pred = predictions.select(*keys, *[c for c in predictions.columns if c not in keys and c != "smiles"],
                              F.col("smiles").alias("pred_smiles"))
    return truth.withColumnRenamed("smiles", "gt_smiles").join(pred, list(keys), "left")


def evaluate(
    truth: DataFrame, images: DataFrame, predictions: DataFrame, modes: Sequence[str], key: Callable[[Column], Column],
    valid: Callable[[Column], Column], similarity: Callable[[Column, Column], Column], ids: Sequence[str] = ("benchmark", "image_id"),
) -> DataFrame:
    """Scored pairs (ids, mode, ok, gt_smiles, pred_smiles, match, sim) of two tables.

    ``truth`` (ids, smiles) is cut to rows whose image is listed in ``images`` (ids). Every row
    is held against its prediction of each mode in ``predictions`` (ids, mode, smiles); one
    that is absent, null or not readable has failed. Both sides are compared by ``key``. Truth
    that is not readable is not ok: it counts in the total and nowhere else. Of several
    predictions under one key the least counts. ``benchmark_metrics`` and
    ``metrics_by_mode`` sum the rows up, ``evaluation_records`` lists one mode's.
    """
    ids = list(ids)
    listed = truth.join(images.select(*ids).distinct(), ids, "left_semi")
    readable = lambda c: F.coalesce(valid(c), F.lit(False))
    # Judged and keyed first, then repeated per mode: beside the explode both ran once per mode.
    judged = listed.select(*ids, readable(F.col("smiles")).alias("ok"), key(F.col("smiles")).alias("gt_smiles"))
    asked = judged.select("*", F.explode(F.array(*[F.lit(m) for m in modes])).alias("mode"))
    given = predictions.filter(F.col("mode").isin(list(modes)) & readable(F.col("smiles")))
    given = given.groupBy(*ids, "mode").agg(F.min(key(F.col("smiles"))).alias("pred_smiles"))
    pairs = asked.join(given, [*ids, "mode"], "left")
    return score_pairs(pairs, similarity(F.col("pred_smiles"), F.col("gt_smiles")))


def evaluation_records(scored: DataFrame, mode: str, ids: Sequence[str] = ("benchmark", "image_id")) -> DataFrame:
    """One row per image of a mode with what happened to it."""
    status = (
        F.when(~F.col("ok"), "bad_truth").when(F.col("pred_smiles").isNull(), "failed").when(F.col("match"), "match").otherwise("differs")
    )
    return scored.filter(F.col("mode") == mode).select(*ids, "gt_smiles", "pred_smiles", "sim", status.alias("status"))


def score_pairs(pairs: DataFrame, similarity: Column) -> DataFrame:
    """Exact match and similarity per pair; rows with bad truth or no prediction score 0."""
    usable = F.col("ok") & F.col("pred_smiles").isNotNull()
    return pairs.withColumns(
        {
            "match": usable & (F.col("pred_smiles") == F.col("gt_smiles")),
            "sim": F.when(usable, similarity).otherwise(0.0),
        }
    )


def benchmark_metrics(scored: DataFrame, keys: Sequence[str] = ("benchmark",)) -> DataFrame:
    """Accuracy in percent and mean similarity over rows with good truth; a missing
    prediction counts with similarity 0; empty sets score 0."""
    ok = F.col("ok")
    valid = F.count_if(ok)
    return scored.groupBy(*keys).agg(
        F.coalesce(F.try_divide(F.count_if(ok & F.col("match")) * 100.0, valid), F.lit(0.0)).alias("exact_match_acc"),
        F.coalesce(F.avg(F.when(ok, F.col("sim"))), F.lit(0.0)).alias("avg_similarity"),
        F.count(F.lit(1)).alias("total"),
        valid.alias("valid"),
        F.count_if(ok & F.col("pred_smiles").isNull()).alias("failed_predictions"),
    )


def metrics_by_mode(scored: DataFrame, keys: Sequence[str] = ("benchmark", "mode")) -> DataFrame:
    """Accuracy as a fraction over good-truth rows, per mode."""
    good = scored.filter("ok")
    return good.groupBy(*keys).agg(
        F.avg(F.col("match").cast("double")).alias("exact_match_acc"),
        F.avg("sim").alias("avg_similarity"),
        F.count_if(F.col("pred_smiles").isNull()).alias("failed"),
    )


def summary_table(metrics: DataFrame, row: str, column: str, value: str, columns: Sequence[str]) -> DataFrame:
    return metrics.groupBy(row).pivot(column, list(columns)).agg(F.first(value))


def group_advantage(candidates: DataFrame, key: str, reward: Column, baseline: float | None = None) -> DataFrame:
    """Reward against its group: standardised by the sample deviation, centred where that
    vanishes, and against the running baseline for a group of one."""
    staged = candidates.withColumn("reward", reward)
    stats = with_group_stats(
        staged, [key], _n=F.count(F.lit(1)), _mean=F.avg("reward"), _std=F.stddev_samp("reward")
    )
    lone = F.col("reward") - (F.col("reward") if baseline is None else F.lit(baseline))
    centred = F.col("reward") - F.col("_mean")
    value = (
        F.when(F.col("_n") < 2, lone)
        .when(F.col("_std") > 1e-8, F.try_divide(centred, F.col("_std")))
        .otherwise(centred)
    )
    return stats.withColumn("advantage", value).drop("_n", "_mean", "_std")


def sample_advantages(
    samples: DataFrame, batch: str, group: str, distance: str = "distance", alpha: float = 0.1, every: int = 64, penalty: float = INVALID_DISTANCE
) -> DataFrame:
    """Rows with ``reward`` and ``advantage``: sampled candidates against their group.

    A reward is minus the distance, or minus ``penalty`` for an invalid sample (null
    distance). In a group of two and more it is standardised by the sample deviation, or
    centred where that vanishes. A group of one is held against the running baseline: the
    moving average over the batches before of the mean reward of their valid samples (minus
    ``penalty`` where a batch has none), started by the first batch's; in the first batch,
    where there is none yet, against its own reward. ``batch`` numbers the batches.
    """
    valid = F.col(distance).isNotNull()
    staged = samples.withColumn("reward", F.when(valid, -F.col(distance)).otherwise(F.lit(-penalty)))
    means = staged.groupBy(batch).agg(F.coalesce(F.avg(F.when(valid, F.col("reward"))), F.lit(-penalty)).alias("_mean"))
    # One row per batch: the baseline after a batch is the one that the next batch meets.
    run = ema_baseline(means, [], {"b": F.floor(F.col(batch) / every)}, [batch], "_mean", alpha)
    after = run.select(F.col("step").alias("_step"), F.col("baseline").alias("_baseline"))
    before = run.select(F.col(batch).alias("_batch"), (F.col("step") - 1).alias("_step")).join(after, "_step", "left")
    based = staged.join(before.drop("_step"), F.col(batch) == F.col("_batch"), "left").drop("_batch")
    stats = with_group_stats(based, [batch, group], _n=F.count(F.lit(1)), _mean=F.avg("reward"), _std=F.stddev_samp("reward"))
    centred = F.col("reward") - F.col("_mean")
    value = (
        F.when(F.col("_n") < 2, F.col("reward") - F.coalesce("_baseline", "reward"))
        .when(F.col("_std") > 1e-8, F.try_divide(centred, F.col("_std"))).otherwise(centred)
    )
    return stats.withColumn("advantage", value).drop("_n", "_mean", "_std", "_baseline")


def mean_risk(candidates: DataFrame, key: str, cost: Column, log_prob: str = "log_prob", alpha: float = 1.0) -> DataFrame:
    """One row: the expected cost of a group, averaged over the groups."""
    return expected_risk(candidates, key, cost, log_prob, alpha).agg(F.avg("risk").alias("risk"), F.count(F.lit(1)).alias("n_groups"))


def expected_risk(candidates: DataFrame, key: str, cost: Column, log_prob: str = "log_prob", alpha: float = 1.0) -> DataFrame:
    """Cost of each group under the softmax of its scaled log-probabilities."""
    staged = candidates.select(key, (F.col(log_prob) * alpha).alias("_l"), cost.alias("_c"))
    shifted = with_group_stats(staged, [key], _max=F.max("_l")).withColumn("_w", F.exp(F.col("_l") - F.col("_max")))
    return shifted.groupBy(key).agg((F.sum(F.col("_w") * F.col("_c")) / F.sum("_w")).alias("risk"))


def class_softmax(logits: DataFrame, keys: Sequence[str], logit: str = "logit") -> DataFrame:
    """Probabilities per key over its classes. A key has one row per class, so the window over
    it is small, and no table of keys is joined back, which could become a broadcast."""
    whole = Window.partitionBy(*keys)
    weighed = logits.withColumn("_e", F.exp(F.col(logit) - F.max(logit).over(whole)))
    return weighed.withColumn("p", F.col("_e") / F.sum("_e").over(whole)).drop("_e")


def symmetrise_edges(probs: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Bond class per ordered atom pair after averaging both directions.

    Classes 0-4 are averaged as they are, 5 and 6 crosswise. Rows of both directions are
    sent once, to the pair's cell with the smaller atom first, and the other direction is
    read from the same cells; one shuffle serves both aggregations. On the diagonal a row
    counts for its class and for the mirrored one. Ties go to the lowest class."""
    swap = lambda k: F.when(k == 5, 6).when(k == 6, 5).otherwise(k)
    i, j, k = F.col("i"), F.col("j"), F.col("k")
    own, mirrored = k.alias("k"), swap(k).alias("k")
    classes = F.when(i < j, F.array(own)).when(i > j, F.array(mirrored)).otherwise(F.array(own, mirrored))
    ends = [F.least(i, j).alias("i"), F.greatest(i, j).alias("j")]
    cells = probs.select(sample, *ends, "p", F.explode(classes).alias("k")).repartition(sample, "i", "j")
    mean = cells.groupBy(sample, "i", "j", "k").agg(F.avg("p").alias("p"))
    best = lambda c: F.max_by(c, F.struct("p", -c))
    pairs = mean.groupBy(sample, "i", "j").agg(best(k).alias("code"), best(swap(k)).alias("_back"), F.max("p").alias("p"))
    there, back = F.struct("i", "j", "code"), F.struct(j.alias("i"), i.alias("j"), F.col("_back").alias("code"))
    ways = F.when(i < j, F.array(there, back)).otherwise(F.array(there))
    return pairs.select(sample, "p", F.explode(ways).alias("w")).select(sample, "w.i", "w.j", "w.code", "p")


def reward_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.avg("reward").alias("mean_reward"),
        F.avg("cost").alias("mean_cost"),
        F.avg("log_prob").alias("mean_log_prob"),
        F.avg("sim").alias("mean_similarity"),
        F.count_if("exact").alias("exact_matches"),
        F.count_if("valid").alias("valid_count"),
    )


def score_candidates(candidates: DataFrame, weights=(0.1, 0.5, 0.4)) -> DataFrame:
    sim = F.when(F.col("valid"), F.col("sim")).otherwise(0.0)
    reward = N.composite_reward(F.col("valid"), sim, F.col("exact"), weights)
    return candidates.withColumn("sim", sim).withColumn("reward", reward).withColumn("cost", 1.0 - F.col("reward"))


def distance_stats(
    df: DataFrame, distance: Column, valid: Column, keys: Sequence[str] = (), image: str | None = None
) -> DataFrame:
    """Distances over valid samples. The valid ratio is that of images with a valid sample
    over all images; without an ``image`` column each row is an image of its own."""
    if image is not None:
        flagged = df.withColumns({"_d": distance, "_v": valid})
        valid = F.col("_v")
        one = flagged.groupBy(*keys, image).agg(
            F.min(F.when(valid, F.col("_d"))).alias("_lo"), F.sum(F.when(valid, F.col("_d"))).alias("_sum"),
            F.max(F.when(valid, F.col("_d"))).alias("_hi"), F.count_if(valid).alias("_n"),
        )
        share = F.avg((F.col("_n") > 0).cast("double"))
        empty = F.lit(INVALID_DISTANCE)
        return one.groupBy(*keys).agg(
            F.coalesce(F.min("_lo"), empty).alias("min_distance"),
            F.coalesce(F.try_divide(F.sum("_sum"), F.sum("_n")), empty).alias("avg_distance"),
            F.coalesce(F.max("_hi"), empty).alias("max_distance"),
            share.alias("valid_ratio"), (F.lit(1.0) - share).alias("invalid_ratio"),
        )
    d = F.when(valid, distance)
    empty = F.lit(INVALID_DISTANCE)
    return df.groupBy(*keys).agg(
        F.coalesce(F.min(d), empty).alias("min_distance"),
        F.coalesce(F.avg(d), empty).alias("avg_distance"),
        F.coalesce(F.max(d), empty).alias("max_distance"),
        F.avg(valid.cast("double")).alias("valid_ratio"),
        F.avg((~valid).cast("double")).alias("invalid_ratio"),
    )


def triplet_distances(triplets: DataFrame, items: DataFrame, item: str, vector: str, eps: float = 0.0) -> DataFrame:
    """Anchor-positive and anchor-negative distances; vectors come by id."""
    out = triplets
    for role in ("anchor", "positive", "negative"):
        out = out.join(items.select(F.col(item).alias(role), F.col(vector).alias(f"_{role}")), role)
    return out.select(
        *triplets.columns,
        N.l2_distance(F.col("_anchor"), F.col("_positive"), eps).alias("d_pos"),
        N.l2_distance(F.col("_anchor"), F.col("_negative"), eps).alias("d_neg"),
    )


def triplet_loss(distances: DataFrame, margin: float) -> DataFrame:
    return distances.agg(
        F.avg(F.greatest(F.col("d_pos") - F.col("d_neg") + margin, F.lit(0.0))).alias("loss"),
        F.count(F.lit(1)).alias("n"),
    )
