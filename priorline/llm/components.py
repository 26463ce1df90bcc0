"""Connected components of a graph given by edges."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorline.session import materialize

MOST_ROUNDS = 100
#: A graph contracted to so few edges is finished in one task.
FEW_EDGES = 20_000


def components(edges: DataFrame) -> DataFrame:
    """(a, b) to (node, label): the least node of each component.

    Each round every node goes over to the one among itself and its neighbours that comes first in an order
    drawn anew by hash; edges are then contracted, and loops and repeats dropped. A round takes a constant
    share of the nodes away, whatever the graph's shape, so rounds grow with the logarithm of its size and
    all rounds together handle a few times the rows of the first. What is left of at most FEW_EDGES edges
    is finished in one task, as rounds over so little are all overhead."""
    e = materialize(_contracted(edges.select("a", "b")), "edges")
    moves: list[DataFrame] = []
    while e.count() > FEW_EDGES:
        if len(moves) == MOST_ROUNDS:
            raise RuntimeError("components didn't settle")
        near = e.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to")))).alias("x")).select("x.*")
        order = lambda c, k=len(moves): F.struct(F.xxhash64(c, F.lit(k)), F.col(c))
        first = near.groupBy("node").agg(F.min(order("to")).alias("first"))
        move = materialize(first.select("node", F.when(order("node") < F.col("first"), F.col("node")).otherwise(F.col("first")["to"]).alias("up")), "moves")
        moves.append(move)
        one, two = move.select(F.col("node").alias("a"), F.col("up").alias("a_up")), move.select(F.col("node").alias("b"), F.col("up").alias("b_up"))
        e = materialize(_contracted(e.join(one, "a").join(two, "b").select(F.col("a_up").alias("a"), F.col("b_up").alias("b"))), "edges")
    moves.append(materialize(e.coalesce(1).mapInPandas(_finish, "node long, up long"), "moves"))
    places = moves[-1]
    for move in reversed(moves[:-1]):  # from the smallest graph back to the first
        later = places.select(F.col("node").alias("up"), F.col("up").alias("end"))
        places = materialize(move.join(later, "up", "left").select("node", F.coalesce("end", "up").alias("up")), "places")
    least = places.groupBy("up").agg(F.min("node").alias("label"))
    return places.join(least, "up").select("node", "label")


def _contracted(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union and find over at most FEW_EDGES edges."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.a.tolist(), batch.b.tolist(), strict=True):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    yield pd.DataFrame({"node": list(up), "up": [find(x) for x in up]}, dtype="int64")
