"""A softmax mixture of frozen arms: weights by context, fitted on the mixture's log loss."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorline.functions.probability import log_loss
from priorline.session import materialize

PASSES, SETTLED = 30, 1e-9
#: Parts of a step that a line search tries in one pass.
PARTS = tuple(0.5**k for k in range(10))


@dataclass(frozen=True)
class Mixture:
    """``theta`` has a row for each context column and a column for each arm; contexts are divided by ``scales``."""

    context: list[str]
    arms: list[str]
    scales: list[float]
    theta: list[list[float]]

    def weights(self) -> Column:
        """The arms' weights of a row, an array that sums to 1; a missing context counts as 0."""
        x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) / F.lit(s) for c, s in zip(self.context, self.scales, strict=True)]
        logits = F.array(*[sum((F.lit(row[a]) * v for row, v in zip(self.theta, x, strict=True)), F.lit(0.0)) for a in range(len(self.arms))])
        raised = F.transform(logits, lambda z: F.exp(z - F.array_max(logits)))
        return F.transform(raised, lambda e: e / F.aggregate(raised, F.lit(0.0), lambda s, v: s + v))

    def forecast(self, weights: str) -> Column:
        """The mixture's probability, from a column that holds ``weights``."""
        return sum((F.col(weights)[k] * F.col(arm) for k, arm in enumerate(self.arms)), F.lit(0.0))


def fit_mixture(rows: DataFrame, context: list[str], arms: list[str], won: str, *, l2: float = 0.01) -> Mixture:
    """The mixture with the least mean log loss plus l2/2 |theta|^2, from theta 0. A pass sums loss, slope and curvature of
    all rows as arrays whose size is set by contexts and arms alone; a second one tries PARTS of the Newton step together.
    Directions of negative curvature are followed downwards, so that every step lowers the loss. Rows need a label and arms
    within 0 to 1; others, and no rows at all, are an error."""
    c, a = len(context), len(arms)
    number = lambda name: F.col(name).cast("double")
    x = F.array(*[F.coalesce(number(n), F.lit(0.0)) for n in context])
    held = materialize(rows.select(x.alias("x"), F.array(*[number(n) for n in arms]).alias("p"), F.col(won).cast("boolean").alias("won")), "mixture")
    inside = F.forall("p", lambda p: (p > 0) & (p < 1) & p.isNotNull()) & F.col("won").isNotNull()
    finite = F.forall("x", lambda v: F.abs(v) < float("inf"))
    checked = held.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(inside & finite, F.lit(False))).alias("bad"), *[F.sqrt(F.avg(F.col("x")[k] * F.col("x")[k])).alias(f"s{k}") for k in range(c)]).head()
    if not checked.n or checked.bad:
        raise ValueError(f"{checked.bad} of {checked.n} rows have no label, an arm that is not within 0 to 1 or a context that is not finite")
    scales = np.array([checked[f"s{k}"] or 1.0 for k in range(c)])

    def summed(thetas: np.ndarray, curved: bool) -> np.ndarray:
        """Means over all rows: the loss under each of ``thetas``, or loss, slope and curvature under the only one."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + c * a + (c * a) ** 2 if curved else len(thetas))
            for batch in batches:
                xs = batch.column(0).flatten().to_numpy().reshape(-1, c) / scales
                ps = batch.column(1).flatten().to_numpy().reshape(-1, a)
                q = np.where(batch.column(2).to_numpy(zero_copy_only=False)[:, None], ps, 1 - ps)
                for k, theta in enumerate(thetas):
                    z = xs @ theta
                    w = np.exp(z - z.max(1, keepdims=True))
                    w /= w.sum(1, keepdims=True)
                    mixed = (w * q).sum(1)
                    total[0 if curved else k] -= np.log(mixed).sum()
                if curved:
                    share = w * q / mixed[:, None]  # each arm's part of what came out
                    total[1 : 1 + c * a] += (xs.T @ (w - share)).ravel()
                    bend = np.zeros((c, a, c, a))
                    for i in range(a):
                        for j in range(a):
                            h = share[:, i] * share[:, j] - w[:, i] * w[:, j] + (i == j) * (w[:, i] - share[:, i])
                            bend[:, i, :, j] = xs.T @ (xs * h[:, None])
                    total[1 + c * a :] += bend.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["k", "part"])

        found = held.mapInArrow(run, "k long, part double").groupBy("k").agg(F.sum("part").alias("total")).collect()  # one number for each entry
        return np.array([r.total for r in sorted(found, key=lambda r: r.k)]) / checked.n

    theta = np.zeros((c, a))
    for _ in range(PASSES):
        got = summed(theta[None], True)
        slope = got[1 : 1 + c * a] + l2 * theta.ravel()
        values, vectors = np.linalg.eigh(got[1 + c * a :].reshape(c * a, c * a) + l2 * np.eye(c * a))
        step = (vectors @ ((vectors.T @ slope) / np.maximum(np.abs(values), l2 / 10 or 1e-12))).reshape(c, a)
        tried = np.array([theta - part * step for part in PARTS])
        losses = summed(tried, False) + l2 / 2 * (tried**2).sum((1, 2))
        best = int(np.argmin(losses))
        if losses[best] >= got[0] + l2 / 2 * (theta**2).sum():
            break
        theta = tried[best]
        if np.abs(PARTS[best] * step).max() < SETTLED:
            break
    return Mixture(context, arms, scales.tolist(), theta.tolist())


def mixture_losses(rows: DataFrame, mixture: Mixture, won: str) -> DataFrame:
    """name, loss: mean log losses of each arm, of the best arm of each row ('oracle') and of the mixture."""
    scored = rows.withColumn("_w", mixture.weights())
    losses = [log_loss(F.col(arm), F.col(won)) for arm in mixture.arms]
    named = dict(zip(mixture.arms, losses, strict=True)) | {"oracle": F.least(*losses), "mixture": log_loss(mixture.forecast("_w"), F.col(won))}
    one = scored.agg(*[F.avg(v).alias(k) for k, v in named.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("loss")) for k in named])).alias("x")).select("x.*")


def mean_weights(rows: DataFrame, mixture: Mixture, bucket: Column) -> DataFrame:
    """bucket, n and arm, weight: the arms' mean weights in each bucket of rows."""
    each = rows.select(bucket.alias("bucket"), mixture.weights().alias("w"))
    means = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col("w")[k]).alias(arm) for k, arm in enumerate(mixture.arms)])
    return means.select("bucket", "n", F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(a).alias("weight")) for a in mixture.arms])).alias("x")).select("bucket", "n", "x.*")
