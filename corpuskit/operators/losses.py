"""Reductions the trainers use, over tables of vectors, logits and log-probabilities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.config import PreferenceConfig
from corpuskit.functions import numeric
from corpuskit.functions.sequence import IGNORE

_CONTRAST = "loss_sum double, n_anchors bigint, pos_sum double, n_pos bigint, neg_sum double, n_neg bigint"


def contrastive_parts(rows: DataFrame, batch: str, vector: str, speaker: str, temperature: float = 0.1, null_speaker: int = -1) -> DataFrame:
    """Per batch the sums behind the supervised contrastive loss and its diagnostics.

    A batch is bounded by its configured size; its rows come together in one list, and its
    similarities are one matrix product, so no pair of rows becomes a row. Vectors are
    normalised first. Null rows neither anchor nor count; an anchor needs a positive.
    """
    lists = rows.where((F.col(speaker) != null_speaker) & F.col(vector).isNotNull()).groupBy(batch).agg(F.collect_list(F.struct(F.col(speaker).cast("bigint").alias("s"), F.transform(vector, lambda x: x.cast("double")).alias("v"))).alias("m"))
    kind = rows.schema[batch].dataType.simpleString()

    def reduce_batch(members: list[dict]) -> tuple:
        x = np.array([m["v"] for m in members])
        s = np.array([m["s"] for m in members])
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        cosine = x @ x.T
        same, other = s[:, None] == s[None, :], ~np.eye(len(s), dtype=bool)
        pos, neg = same & other, ~same
        scaled = np.where(other, cosine / temperature, -np.inf)
        if len(s) < 2:
            return 0.0, 0, 0.0, 0, 0.0, 0
        top = scaled.max(1, keepdims=True)
        log_prob = scaled - top - np.log(np.exp(scaled - top).sum(1, keepdims=True))
        n = pos.sum(1)
        per_anchor = -np.where(pos, log_prob, 0.0).sum(1) / np.maximum(n, 1)
        return float(per_anchor[n > 0].sum()), int((n > 0).sum()), float(cosine[pos].sum()), int(pos.sum()), float(cosine[neg].sum()), int(neg.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _CONTRAST.split(", ")]
        types = [pa.float64() if c.split()[1] == "double" else pa.int64() for c in _CONTRAST.split(", ")]
        for b in batches:
            rows = [reduce_batch(m) for m in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]], [batch, *names])

    return lists.mapInArrow(run, f"`{batch}` {kind}, {_CONTRAST}")


def contrastive_loss(parts: DataFrame, batch: str) -> DataFrame:
    """Loss (0 without anchors), mean similarities, separation and counts per batch."""
    mean = lambda a, n: F.coalesce(F.try_divide(F.col(a), F.col(n)), F.lit(0.0))
    pos, neg = mean("pos_sum", "n_pos"), mean("neg_sum", "n_neg")
    return parts.select(batch, mean("loss_sum", "n_anchors").alias("loss"), pos.alias("pos_sim_mean"), neg.alias("neg_sim_mean"), (pos - neg).alias("separation"), "n_anchors", mean("n_pos", "n_anchors").alias("n_positives_avg"))


def combined_logprob(tokens: Column, stop: Column, n_frames: Column, cfg: PreferenceConfig) -> Column:
    total = tokens + stop * F.lit(cfg.stop_weight)
    return total / F.greatest(F.lit(1), n_frames) if cfg.length_normalise else total


def pair_weight(margin: Column, cfg: PreferenceConfig) -> Column:
    """Unnormalised weight of a pair by its reward margin."""
    if cfg.weight_mode == "none":
        return F.lit(1.0)
    m = margin / F.lit(max(cfg.weight_scale, 1e-8))
    return numeric.clamp(m + F.lit(1.0) if cfg.weight_mode == "linear" else m, 1.0 / cfg.weight_max, cfg.weight_max)


def preference_loss(pairs: DataFrame, cfg: PreferenceConfig, by: tuple[str, ...] = ()) -> DataFrame:
    """Weighted mean of -log sigmoid(beta * margin) and metrics, from ``pi_chosen, pi_rejected, ref_chosen, ref_rejected, weight``."""
    logits = F.lit(cfg.beta) * ((F.col("pi_chosen") - F.col("ref_chosen")) - (F.col("pi_rejected") - F.col("ref_rejected")))
    rows = pairs.withColumn("_logit", logits).withColumn("_loss", numeric.softplus(-F.col("_logit")))
    return rows.groupBy(*by).agg(
        (F.sum(F.col("weight") * F.col("_loss")) / F.greatest(F.sum("weight"), F.lit(1e-8))).alias("loss"),
        F.avg(F.when(F.col("_logit") > 0, 1.0).otherwise(0.0)).alias("accuracy"),
        F.avg(F.col("pi_chosen") - F.col("pi_rejected")).alias("margin"),
        F.count("*").alias("n_pairs"),
    )


def trajectory_logprob(df: DataFrame, token_logp: str, stop_logit: str, truncated: str, floor: float) -> DataFrame:
    """Adds ``logp_tokens, logp_stop, n_frames`` from per-frame token log-probabilities ``array<array<double>>`` and stop logits ``array<double>``.

    Stops are a Bernoulli chain: no stop before the last frame, and a stop at it unless truncated.
    """
    tokens = F.aggregate(F.flatten(token_logp), F.lit(0.0), lambda s, x: s + x)
    p = F.transform(stop_logit, lambda z: numeric.clamp(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), floor, 1.0 - floor))
    n = F.size(stop_logit)
    before = F.aggregate(F.slice("_p", F.lit(1), F.greatest(F.lit(0), n - 1)), F.lit(0.0), lambda s, x: s + F.log1p(-x))
    last = F.when(F.col(truncated), 0.0).otherwise(F.coalesce(F.log(F.try_element_at("_p", F.lit(-1))), F.lit(0.0)))
    return df.withColumn("_p", p).withColumns({"logp_tokens": tokens, "logp_stop": before + last, "n_frames": n}).drop("_p")


def masked_cross_entropy(df: DataFrame, logits: str, label: str, by: tuple[str, ...]) -> DataFrame:
    """Mean cross entropy of the rows whose label is not ignored, per head; 0 where all are."""
    rows = df.withColumn("_l", F.when(F.col(label) != IGNORE, -F.element_at(numeric.log_softmax(F.col(logits)), (F.when(F.col(label) >= 0, F.col(label)).otherwise(F.lit(0)) + 1).cast("int"))))
    return rows.groupBy(*by).agg(F.coalesce(F.avg("_l"), F.lit(0.0)).alias("loss"), F.count("_l").alias("n_labels"))


def masked_stop_loss(df: DataFrame, logit: str, label: str, positive_weight: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean binary cross entropy with a weight on stops; ignored labels are out, 0 where all are."""
    z, y = F.col(logit).cast("double"), F.col(label)
    loss = F.when(y == 1, F.lit(positive_weight) * numeric.softplus(-z)).when(y == 0, numeric.softplus(z))
    return df.withColumn("_l", loss).groupBy(*by).agg(F.coalesce(F.avg("_l"), F.lit(0.0)).alias("loss"), F.count("_l").alias("n_labels"))


def _queries(vector: Column, k: int) -> Column:
    """A flat vector as ``k`` rows of equal length."""
    d = (F.size(vector) / k).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.slice(vector, i * d + 1, d))


def hinge_variance(vector: Column, k: int, gamma: float = 0.5) -> Column:
    """mean over dimensions of max(0, gamma - std over the k queries), the std (population) no less than 1e-4."""
    q = _queries(vector, k)
    dims = F.transform(F.get(q, F.lit(0)), lambda x, j: F.transform(q, lambda r: F.get(r, j).cast("double")))
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / F.size(xs)
    std = F.transform(dims, lambda xs: F.greatest(F.lit(1e-4), F.sqrt(mean(F.transform(xs, lambda x: (x - mean(xs)) * (x - mean(xs)))))))
    return mean(F.transform(std, lambda s: F.greatest(F.lit(0.0), F.lit(gamma) - s)))


def query_cosines(df: DataFrame, vector: str, k: int) -> DataFrame:
    """Adds ``cos_mean, cos_max`` over the off-diagonal cosines of the k queries in a flat vector; k is a small constant."""
    q = _queries(F.col(vector), k)
    staged = df.withColumn("_q", F.transform(q, lambda r: numeric.unit(r)))
    pairs = [numeric.dot(F.col("_q")[i], F.col("_q")[j]) for i in range(k) for j in range(i)]
    staged = staged.withColumn("_c", F.array(*pairs))
    return staged.withColumns({"cos_mean": F.aggregate("_c", F.lit(0.0), lambda s, x: s + x) / F.size("_c"), "cos_max": F.array_max("_c")}).drop("_q", "_c")


def query_spread(vector: Column, k: int) -> Column:
    """Mean over dimensions of the standard deviation (of a sample) across the k queries of a flat vector."""
    q = _queries(vector, k)
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / F.size(xs)
    dims = F.transform(F.get(q, F.lit(0)), lambda x, j: F.transform(q, lambda r: F.get(r, j).cast("double")))
    return mean(F.transform(dims, lambda xs: F.sqrt(mean(F.transform(xs, lambda x: (x - mean(xs)) * (x - mean(xs)))) * F.lit(k / max(k - 1, 1)))))


def total_loss(heads: DataFrame, stop: DataFrame, batch: str, stop_weight: float) -> DataFrame:
    """``batch, loss``: mean of the heads' losses plus the weighted stop loss; a batch without either counts it as 0."""
    mean = heads.groupBy(batch).agg(F.avg("loss").alias("_h"))
    return mean.join(stop.select(batch, F.col("loss").alias("_s")), batch, "full").select(batch, (F.coalesce("_h", F.lit(0.0)) + F.lit(stop_weight) * F.coalesce("_s", F.lit(0.0))).alias("loss"))
