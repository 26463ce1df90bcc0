"""Small models fitted by passes over the whole table, and seeded resampling."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorline.functions.probability import sigmoid
from priorline.session import materialize

PASSES, SETTLED = 12, 1e-10
#: Draws that one task works on.
AT_ONCE = 250


def offset_logistic(rows: DataFrame, features: list[str], label: str, offset: str | None = None, *, l2: float = 0.01, intercept: bool = False) -> dict[str, float]:
    """Weights that minimise mean log loss of sigmoid(offset + w.x) plus l2/2 |w|^2. The loss is convex: each
    Newton step takes one aggregate over the rows, of a size set by the number of features alone, and a
    handful of steps reaches the optimum that gradient descent approaches."""
    names = [*features, *(["intercept"] if intercept else [])]
    held = materialize(rows.select(F.col(label).cast("double").alias("_y"), (F.col(offset) if offset else F.lit(0.0)).alias("_o"), *[F.col(f).cast("double").alias(f) for f in features]), "fit")
    x: list[Column] = [F.col(f) for f in features] + ([F.lit(1.0)] if intercept else [])
    w = np.zeros(len(x))
    for _ in range(PASSES):
        p = sigmoid(F.col("_o") + sum((F.lit(float(v)) * c for v, c in zip(w, x, strict=True)), F.lit(0.0)))
        scored = held.withColumn("_p", p)
        slope = [F.avg((F.col("_p") - F.col("_y")) * c) for c in x]
        bend = [F.avg(F.col("_p") * (1 - F.col("_p")) * x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x))]
        got = [float(v or 0.0) for v in scored.agg(*[c.alias(f"c{k}") for k, c in enumerate([*slope, *bend])]).head()]
        h = np.zeros((len(x), len(x)))
        h[np.triu_indices(len(x))] = got[len(x) :]
        h = h + np.triu(h, 1).T + l2 * np.eye(len(x))
        step = np.linalg.solve(h, np.array(got[: len(x)]) + l2 * w)
        w = w - step
        if np.abs(step).max() < SETTLED:
            break
    return dict(zip(names, w.tolist(), strict=True))


def offset_logistic_by(rows: DataFrame, by: list[str], features: list[str], label: str, offset: str | None = None, *, l2: float = 0.01) -> DataFrame:
    """``by`` and w, an array: the fit of ``offset_logistic`` for each key, all at once. A step is one grouped aggregate over
    all rows, whatever the number of keys, joined with the keys' weights of the step before; the small systems, one a
    key, are solved in the tasks that hold them. It ends when no key's weights move by more than SETTLED."""
    n = len(features)
    x = [F.col(f"_x{i}") for i in range(n)]
    held = materialize(rows.select(*by, F.col(label).cast("double").alias("_y"), (F.col(offset) if offset else F.lit(0.0)).alias("_o"), *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)]), "fit")
    weights = held.select(*by).distinct().withColumn("w", F.array(*[F.lit(0.0)] * n))
    upper = [(i, j) for i in range(n) for j in range(i, n)]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[len(by) + 1 :]], 1)
            w = batch.column(len(by)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            h = np.zeros((len(w), n, n))
            for k, (i, j) in enumerate(upper):
                h[:, i, j] = h[:, j, i] = got[:, n + k]
            step = np.linalg.solve(h + l2 * np.eye(n), (got[:, :n] + l2 * w)[:, :, None])[:, :, 0]
            lists = pa.array(list(w - step), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by)], lists, pa.array(np.abs(step).max(1))], names=[*by, "w", "_moved"])

    schema = weights.withColumn("_moved", F.lit(0.0)).schema
    for _ in range(PASSES):
        told = weights.select(*by, "w")
        scored = held.join(told, by).withColumn("_p", sigmoid(F.col("_o") + sum((F.col("w")[i] * x[i] for i in range(n)), F.lit(0.0))))
        bend = F.col("_p") * (1 - F.col("_p"))
        slopes, bends = [F.avg((F.col("_p") - F.col("_y")) * c).alias(f"g{i}") for i, c in enumerate(x)], [F.avg(bend * x[i] * x[j]).alias(f"h{i}_{j}") for i, j in upper]
        # Numbers alone are aggregated, which needs no sort; the weights, one row a key, are joined to the sums.
        sums = scored.groupBy(*by).agg(*slopes, *bends).join(told, by)
        weights = materialize(sums.select(*by, "w", *[f"g{i}" for i in range(n)], *[f"h{i}_{j}" for i, j in upper]).mapInArrow(solve, schema), "weights")
        if (weights.agg(F.max("_moved")).head()[0] or 0.0) < SETTLED:
            break
    return weights.select(*by, "w")


def rms_scales(rows: DataFrame, features: list[str]) -> DataFrame:
    """Uncentred root mean squares, 1 for a column of zeros."""
    rms = {f: F.sqrt(F.avg(F.col(f) * F.col(f))) for f in features}
    return rows.agg(*[F.when(c == 0, F.lit(1.0)).otherwise(c).alias(f) for f, c in rms.items()])


def block_bootstrap(blocks: DataFrame, by: str, total: str = "total", n: str = "n", *, draws: int = 10_000, alpha: float = 0.05) -> DataFrame:
    """Per season the one-sided lower bound of the mean: blocks are drawn with replacement, and the bound is the order
    statistic ceil(alpha * draws) of the draws' means. A draw's j-th block is told by a digest of (season, draw, j), so
    that reruns agree. A season has a block for each week; its means, one for each draw, are sorted as one array."""
    ordered = F.array_sort(F.collect_list(F.struct("week", F.col(total).cast("double").alias("t"), F.col(n).cast("long").alias("n"))))
    held = materialize(blocks.groupBy(by).agg(ordered.alias("_b")), "blocks")
    # A season's blocks, one a week, lie on one row, which goes to as many tasks as there are parts of the draws.
    parts = held.select(by, "_b", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // AT_ONCE))).alias("_part")).repartition(F.col(by), F.col("_part"))
    last = F.least((F.col("_part") + 1) * AT_ONCE, F.lit(draws))
    drawn = parts.select(by, "_b", F.explode(F.sequence(F.col("_part") * AT_ONCE + 1, last)).alias("_draw"))

    picks = drawn.select(by, "_b", "_draw", F.explode(F.sequence(F.lit(0), F.size("_b") - 1)).alias("_k"))
    digest = F.substring(F.md5(F.concat_ws("|", F.col(by).cast("string"), F.col("_draw").cast("string"), F.col("_k").cast("string"))), 1, 8)
    picked = picks.select(by, "_draw", F.col("_b")[(F.conv(digest, 16, 10).cast("long") % F.size("_b")).cast("int")].alias("x"))
    # All picks of a draw are in one task, so what is shuffled is a row for each draw.
    means = picked.groupBy(by, "_draw").agg((F.sum("x.t") / F.sum("x.n")).alias("_mean"))
    bounds = means.groupBy(by).agg(F.element_at(F.array_sort(F.collect_list("_mean")), math.ceil(alpha * draws)).alias("lower_bound"))
    each = held.select(by, F.explode("_b").alias("b"))
    whole = each.groupBy(by).agg(F.count(F.lit(1)).alias("n_blocks"), F.sum("b.n").alias("games"), (F.sum("b.t") / F.sum("b.n")).alias("mean"))
    return whole.join(bounds, by).select(by, "n_blocks", "games", "mean", "lower_bound", (F.col("lower_bound") > 0).alias("passes"))


def ridge_ratings(rows: DataFrame, plus: str, minus: str, value: str, weight: str, *, l2: float = 1.0) -> DataFrame:
    """Ridge ratings from weighted rows value = rating[plus] - rating[minus] + home, by normal equations:
    Spark sums one entry for each pair that met, so what the driver solves has the size of the league."""
    table = _pairs(rows, plus, minus, value, weight).toPandas()  # a row for each pair of teams that met
    return rows.sparkSession.createDataFrame(_solve(table, l2), "team int, rating double, home_advantage double")


def causal_ridge_ratings(rows: DataFrame, season: str, plus: str, minus: str, value: str, weight: str, *, seasons: int = 3, l2: float = 1.0) -> DataFrame:
    """For each season that has ``seasons`` seasons before it, ridge ratings from those alone."""
    table = _pairs(rows, plus, minus, value, weight, season).toPandas()  # a row for each season and pair of teams
    first, found = int(table[season].min()), []
    for now in sorted(set(table[season].tolist())):
        if now - seasons >= first:
            earlier = table[(table[season] < now) & (table[season] >= now - seasons)]
            pairs = earlier.groupby(["i", "j"], as_index=False)[["w", "wv"]].sum()
            found += [(int(now), *r) for r in _solve(pairs, l2)]
    return rows.sparkSession.createDataFrame(found, "season int, team int, rating double, home_advantage double")


def _pairs(rows: DataFrame, plus: str, minus: str, value: str, weight: str, *by: str) -> DataFrame:
    w, v = F.col(weight), F.col(value)
    return rows.groupBy(*by, F.col(plus).alias("i"), F.col(minus).alias("j")).agg(F.sum(w).alias("w"), F.sum(w * v).alias("wv"))


def _solve(table: pd.DataFrame, l2: float) -> list[tuple[int, float, float]]:
    names = sorted(set(table.i) | set(table.j))
    at = {x: k for k, x in enumerate(names)}
    m = len(names) + 1
    a, b = np.zeros((m, m)), np.zeros(m)
    for i, j, ww, wv in table[["i", "j", "w", "wv"]].itertuples(index=False):
        x = np.zeros(m)
        x[at[i]] += 1
        x[at[j]] -= 1
        x[-1] = 1
        a += ww * np.outer(x, x)
        b += wv * x
    a[np.arange(m - 1), np.arange(m - 1)] += l2
    rating = np.linalg.lstsq(a, b, rcond=None)[0]
    return [(int(x), float(rating[at[x]]), float(rating[-1])) for x in names]
