"""Sequential folds: rows stream through a task in order, with only the running state held."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def ordered_fold(rows: DataFrame, *, by: list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, tuple], tuple], schema: str) -> DataFrame:
    """Folds each key's rows in order: ``step(state, row)`` changes the state and gives an output row. Keys lie
    in sorted partitions; a key's rows needn't fit in memory, its state must. A key is a sequence, which no number of
    machines shortens: work grows with the longest one."""
    names = [x.split()[0] for x in schema.split(", ")]
    at = [rows.columns.index(c) for c in by]
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = tuple(row[k] for k in at)
                if key != last:
                    last, state = key, start()
                out.append(step(state, row))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds.field(k).type) for k, c in enumerate(zip(*out, strict=True))], names=names)

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def margin_elo(
    games: DataFrame, *, base: float = 1500.0, home: float = 60.0, k: float = 20.0, by: str = "season", carry: float | None = None, neutral: str | None = None, upcoming: str | None = None
) -> DataFrame:
    """Elo with the margin of victory: pregame ratings and home probability of every game, results in order of
    (season, game_date, game_id). Ratings start from ``base`` for each key ``by``; with ``carry`` a new season of the
    key keeps that part of their distance from it. Games that are ``neutral`` have no home edge, those ``upcoming`` read
    ratings and change none; another game without a winner is an error. games: season, game_date, game_id, home, away, hs, as_."""

    def start() -> dict:
        return {"season": None, "ratings": {}}

    def step(state: dict, row: tuple) -> tuple:
        key, season, _, game, h, a, hs, as_, on_neutral, later = row
        if carry is not None and state["season"] not in (None, season):
            state["ratings"] = {t: base + carry * (r - base) for t, r in state["ratings"].items()}
        state["season"], ratings = season, state["ratings"]
        rh, ra = ratings.get(h, base), ratings.get(a, base)
        edge = rh + (0.0 if on_neutral else home) - ra
        p = 1.0 / (1.0 + 10.0 ** (-edge / 400.0))
        if not later:
            if hs == as_:
                raise ValueError(f"game {game} has no winner")
            won = hs > as_
            lead = edge if won else -edge
            shift = k * math.log(abs(hs - as_) + 1.0) * 2.2 / (0.001 * lead + 2.2) * ((1.0 if won else 0.0) - p)
            ratings[h], ratings[a] = rh + shift, ra - shift
        return (game, season, rh, ra, p) if by == "season" else (key, game, season, rh, ra, p)

    flag = lambda c: (F.col(c) if c else F.lit(False)).cast("boolean")
    columns = [F.col(by).alias("_by"), "season", "game_date", "game_id", "home", "away", "hs", "as_", flag(neutral).alias("_neutral"), flag(upcoming).alias("_upcoming")]
    own = "" if by == "season" else f"{by} {games.schema[by].dataType.simpleString()}, "
    schema = f"{own}game_id long, season int, home_rating double, away_rating double, home_p double"
    return ordered_fold(games.select(*columns), by=["_by"], order=["season", "game_date", "game_id"], start=start, step=step, schema=schema)


def batched_elo(rows: DataFrame, *, base: float = 1500.0, k: float = 20.0) -> DataFrame:
    """Elo whose games of one cutoff are frozen together: a result counts from the first later cutoff at or after
    the moment it is known; pending results lie in a heap by that moment. A result that never is (resolved_at null)
    changes nothing. Equal pairs of one cutoff read equal ratings, so those whose results are known at one moment are one row
    of the fold, with counts of games and wins: it grows with cutoffs and pairs, not with games. rows: season, cutoff (long),
    resolved_at (long), game_id, team, opp, won."""

    def start() -> dict:
        return {"ratings": {}, "due": [], "shifts": {}, "cutoff": None, "pair": None}

    def step(state: dict, row: tuple) -> tuple:
        season, cutoff, team, opp, resolved, n, wins = row
        ratings, due, shifts = state["ratings"], state["due"], state["shifts"]
        if cutoff != state["cutoff"]:
            state["cutoff"] = cutoff
            while due and due[0] <= cutoff:
                for t, shift in shifts.pop(heappop(due)).items():
                    ratings[t] = ratings.get(t, base) + shift
        first, state["pair"] = (cutoff, team, opp) != state["pair"], (cutoff, team, opp)
        rt, ro = ratings.get(team, base), ratings.get(opp, base)
        p = 1.0 / (1.0 + 10.0 ** (-(rt - ro) / 400.0))
        if resolved is not None:
            if resolved not in shifts:
                shifts[resolved] = {}
                heappush(due, resolved)
            of, shift = shifts[resolved], k * (wins - n * p)
            of[team] = of.get(team, 0.0) + shift
            of[opp] = of.get(opp, 0.0) - shift
        return season, cutoff, team, opp, rt, ro, p, first

    pair = ["season", "cutoff", "team", "opp"]
    chosen = rows.select(*pair, "resolved_at", "game_id", "won")
    counts = chosen.groupBy(*pair, "resolved_at").agg(F.count(F.lit(1)).alias("n"), F.count_if("won").alias("wins"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("team", "opp")}
    schema = f"season int, cutoff long, team {kinds['team']}, opp {kinds['opp']}, team_rating double, opp_rating double, team_p double, first boolean"
    folded = ordered_fold(counts, by=["season"], order=["cutoff", "team", "opp", "resolved_at"], start=start, step=step, schema=schema)
    rated = folded.where("first").drop("first").withColumnsRenamed({c: f"_{c}" for c in pair})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in pair]
    return chosen.join(rated, same).select("season", "game_id", "team_rating", "opp_rating", "team_p")


def resolved_elo(games: DataFrame, snapshots: DataFrame | None = None, **settings: float) -> DataFrame:
    """``batched_elo`` on the moments at which results became known: of a game's ``snapshots`` (game_id, taken, won) the
    first taken at or after the game ended tells its result and when. Games whose rows hold their own snapshots, as an array
    ``snapshots`` of (taken, won), need no table of them. games: season, cutoff, ended, game_id, team, opp."""
    if snapshots is None:
        first = F.array_min(F.filter("snapshots", lambda x: x["taken"] >= F.col("ended")))
        return batched_elo(games.withColumn("_first", first).select("*", F.col("_first.taken").alias("resolved_at"), F.col("_first.won").alias("won")), **settings)
    ended = games.select("game_id", "ended")
    first = snapshots.join(ended, "game_id").where(F.col("taken") >= F.col("ended")).groupBy("game_id").agg(F.min("taken").alias("resolved_at"), F.min_by("won", "taken").alias("won"))
    return batched_elo(games.join(first, "game_id", "left"), **settings)


def scalar_kalman(rows: DataFrame, *, prior: float = 0.0, prior_var: float = 25.0, drift: float = 1.5, noise: float = 400.0) -> DataFrame:
    """A scalar Kalman filter for each player: the estimate before each observation. rows: player, day (long),
    seq (long), value, weight (observations' precision is weight / noise)."""

    def start() -> list:
        return [prior, prior_var]

    def step(state: list, row: tuple) -> tuple:
        player, day, seq, value, weight = row
        before = state[0]
        variance = state[1] + drift
        if weight > 0:
            gain = variance / (variance + noise / weight)
            state[0] = before + gain * (value - before)
            state[1] = (1.0 - gain) * variance
        else:
            state[1] = variance
        return player, day, seq, before, variance

    chosen = rows.select("player", "day", "seq", "value", "weight")
    return ordered_fold(chosen, by=["player"], order=["day", "seq"], start=start, step=step, schema="player long, day long, seq long, estimate double, variance double")


def seasonal_kalman(rows: DataFrame, priors: DataFrame, *, no_prior: float = 0.0, no_prior_var: float = 100.0, prior_var: float = 25.0, drift: float = 1.5, noise: float = 400.0) -> DataFrame:
    """``scalar_kalman`` that starts anew each season, from the player's prior of that season with variance ``prior_var``
    or, where there is none, from ``no_prior`` with ``no_prior_var``. rows: season, player, day, seq, value, weight; priors:
    season, player, prior, one row for each, from earlier seasons alone."""

    def step(state: list, row: tuple) -> tuple:
        season, player, day, seq, value, weight, prior = row
        if not state:
            state += [no_prior, no_prior_var] if prior is None else [prior, prior_var]
        before, variance = state[0], state[1] + drift
        gain = variance / (variance + noise / weight) if weight > 0 else 0.0
        state[:] = [before + gain * (value - before), (1.0 - gain) * variance]
        return season, player, seq, before, variance, prior is not None

    chosen = rows.select("season", "player", "day", "seq", "value", "weight").join(priors.select("season", "player", "prior"), ["season", "player"], "left")
    schema = "season int, player long, seq long, estimate double, variance double, had_prior boolean"
    return ordered_fold(chosen.select("season", "player", "day", "seq", "value", "weight", "prior"), by=["season", "player"], order=["day", "seq"], start=list, step=step, schema=schema)
