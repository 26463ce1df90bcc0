"""Ridge ratings of players from constant lineups, by sparse normal equations and conjugate gradients over tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from priorline.session import materialize

#: The unknown that stands for the home side's advantage; it has no penalty.
HOME = -1
STEPS, CHECKED, SETTLED = 400, 5, 1e-20
#: Cells of a system that a task may hold, some 100 MB with what is made of them.
MOST_CELLS = 2_000_000


def normal_equations(stints: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """Cells (by, i, j, a) and right sides (by, i, b) of the weighted least squares margin = sum of home - sum of away + HOME.
    stints: by, home and away (arrays of players), margin, weight. A stint has a fixed number of players, so it makes a
    fixed number of cells, which are summed before they are shuffled."""
    signed = lambda players, sign: F.transform(players, lambda p: F.struct(p.cast("long").alias("i"), F.lit(sign).alias("s")))
    everyone = F.concat(signed(F.col("home"), 1.0), signed(F.col("away"), -1.0), F.array(F.struct(F.lit(HOME).cast("long").alias("i"), F.lit(1.0).alias("s"))))
    own = stints.select(by, "margin", "weight", everyone.alias("all")).select("*", F.explode("all").alias("x"))
    right = own.groupBy(by, F.col("x.i").alias("i")).agg(F.sum(F.col("weight") * F.col("x.s") * F.col("margin")).alias("b"))
    pairs = own.select(by, "weight", "x", F.explode("all").alias("y"))
    cells = pairs.groupBy(by, F.col("x.i").alias("i"), F.col("y.i").alias("j")).agg(F.sum(F.col("weight") * F.col("x.s") * F.col("y.s")).alias("a"))
    return cells, right


def conjugate_gradients(cells: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """(by, i, x) that solves each ``by``'s symmetric system, with its diagonal as preconditioner. A step joins the cells
    with the last direction, sums by row, and takes the step's lengths from windows over each ``by``'s unknowns; every
    CHECKED steps one number comes to the driver, the greatest residue. What a task holds is a part of the cells, or the
    unknowns of one system."""
    cells = materialize(cells, "cells")
    diagonal = cells.where("i = j").select(by, "i", F.col("a").alias("d"))
    of = Window.partitionBy(by)
    r = F.col("b")
    start = right.join(diagonal, [by, "i"]).select(by, "i", "d", F.lit(0.0).alias("x"), r.alias("r"), (r / F.col("d")).alias("p"), F.sum(r * r / F.col("d")).over(of).alias("first"))
    state = materialize(start.withColumn("left", F.col("first")), "state")
    for step in range(1, STEPS + 1):
        q = cells.join(state.select(by, F.col("i").alias("j"), "p"), [by, "j"]).groupBy(by, "i").agg(F.sum(F.col("a") * F.col("p")).alias("q"))
        told = state.join(q, [by, "i"]).withColumn("pq", F.sum(F.col("p") * F.col("q")).over(of))
        open_ = (F.col("left") > SETTLED * F.col("first")) & (F.col("pq") > 0)
        told = told.withColumn("alpha", F.when(open_, F.col("left") / F.col("pq")).otherwise(0.0)).withColumn("r2", F.col("r") - F.col("alpha") * F.col("q"))
        told = told.withColumn("after", F.sum(F.col("r2") * F.col("r2") / F.col("d")).over(of))
        p = F.when(open_, F.col("r2") / F.col("d") + F.col("after") / F.col("left") * F.col("p")).otherwise(F.col("p"))
        state = materialize(told.select(by, "i", "d", (F.col("x") + F.col("alpha") * F.col("p")).alias("x"), F.col("r2").alias("r"), p.alias("p"), "first", F.col("after").alias("left")), "state")
        if step % CHECKED == 0 and not state.agg(F.max((F.col("left") > SETTLED * F.col("first")).cast("int"))).head()[0]:
            break
    return state.select(by, "i", "x")


def solve(cells: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """(by, i, x) by conjugate gradients: within a task for each system while no system has more than MOST_CELLS cells, which
    is counted beforehand, else in steps over tables."""
    cells = materialize(cells, "cells")
    if (cells.groupBy(by).count().agg(F.max("count")).head()[0] or 0) > MOST_CELLS:
        return conjugate_gradients(cells, right, by)

    def run(table: pa.Table) -> pa.Table:
        i, j, a = (table.column(c).to_numpy() for c in ("i", "j", "a"))
        names, at = np.unique(i, return_inverse=True)
        side = np.isnan(j)
        b = np.bincount(at[side], a[side], len(names))
        row, a, column = at[~side], a[~side], np.searchsorted(names, j[~side].astype(np.int64))
        d = np.bincount(row[row == column], a[row == column], len(names))
        x, r, p = np.zeros(len(names)), b, b / d
        first = left = float(r @ p)
        for _ in range(STEPS):
            q = np.bincount(row, a * p[column], len(names))
            pq = float(p @ q)
            if left <= SETTLED * first or pq <= 0:
                break
            x, r = x + left / pq * p, r - left / pq * q
            after = float(r @ (r / d))
            p, left = r / d + after / left * p, after
        return pa.table({by: pa.array([table.column(by)[0].as_py()] * len(names), table.schema.field(by).type), "i": names, "x": x})

    rows = cells.select(by, "i", F.col("j").cast("double").alias("j"), "a").unionByName(right.select(by, "i", F.lit(float("nan")).alias("j"), F.col("b").alias("a")))
    return rows.groupBy(by).applyInArrow(run, right.select(by, "i", F.col("b").alias("x")).schema)


def lineup_ratings(stints: DataFrame, season: str, *, seasons: int = 3, l2: float = 0.01, least: float = 0.5) -> DataFrame:
    """season, player, rating, home_advantage: for each season with stints, ratings per 100 possessions from the ``seasons``
    seasons before it alone; they minimise the mean of weight * error^2 plus l2 times the mean squared rating.
    stints: season, home, away (arrays), home_points, away_points, possessions (the mean of both sides'; below ``least``
    a stint is left out). A season with nothing before it has no rows."""
    stints = materialize(stints, "lineups")
    used = stints.where(F.col("possessions") >= least)
    margin = 100.0 * (F.col("home_points") - F.col("away_points")) / F.col("possessions")
    held = materialize(used.select(F.col(season).alias("season"), "home", "away", margin.alias("margin"), F.col("possessions").alias("weight")), "stints")
    cells, right = (materialize(x, "equations") for x in normal_equations(held, "season"))
    later = F.explode(F.sequence(F.col("season") + 1, F.col("season") + seasons)).alias("target")
    targets = stints.select(F.col(season).alias("target")).distinct()
    moved = lambda df, *keys: df.select("*", later).join(targets, "target", "left_semi").groupBy("target", *keys)
    right = materialize(moved(right, "i").agg(F.sum("b").alias("b")), "right")
    weight = moved(held.groupBy("season").agg(F.sum("weight").alias("weight"))).agg(F.sum("weight").alias("weight"))
    # The mean squared rating is over the players, the mean error over the weights.
    penalty = right.where(F.col("i") != HOME).groupBy("target").agg(F.count(F.lit(1)).alias("players")).join(weight, "target").select("target", (l2 * F.col("weight") / F.col("players")).alias("penalty"))
    cells = moved(cells, "i", "j").agg(F.sum("a").alias("a")).join(penalty, "target")
    cells = cells.select("target", "i", "j", (F.col("a") + F.when((F.col("i") == F.col("j")) & (F.col("i") != HOME), F.col("penalty")).otherwise(0.0)).alias("a"))
    x = materialize(solve(cells, right, "target"), "solved")
    home = x.where(F.col("i") == HOME).select("target", F.col("x").alias("home_advantage"))
    return x.where(F.col("i") != HOME).join(home, "target").select(F.col("target").alias("season"), F.col("i").alias("player"), F.col("x").alias("rating"), "home_advantage")
