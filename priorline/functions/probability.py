"""Probability and score expressions over columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scores take no probability below this.
FLOOR = 1e-15


def elo_probability(rating: Column, opponent: Column, venue: Column | float = 0.0) -> Column:
    """Base-10 Elo win probability; ``venue`` is added to the first rating."""
    edge = rating + venue - opponent
    return 1.0 / (1.0 + F.pow(F.lit(10.0), -edge / 400.0))


def log(x: Column) -> Column:
    """The natural logarithm with minus infinity at 0, where Spark's is null."""
    return F.when(x == 0, F.lit(float("-inf"))).otherwise(F.ln(x))


def logit(p: Column) -> Column:
    """Minus infinity at 0, infinity at 1."""
    return log(p) - log(1.0 - p)


def sigmoid(x: Column) -> Column:
    """Written in two branches, so that neither overflows; 0 and 1 at the infinities."""
    return F.when(x >= 0, 1.0 / (1.0 + F.exp(-x))).otherwise(F.exp(x) / (1.0 + F.exp(x)))


def brier(p: Column, won: Column) -> Column:
    return F.pow(p - won.cast("double"), F.lit(2.0))


def log_loss(p: Column, won: Column) -> Column:
    return -F.ln(F.greatest(F.when(won, p).otherwise(1.0 - p), F.lit(FLOOR)))


def multiclass_brier(p: Column, outcome: Column) -> Column:
    """The sum of squared gaps of an array of probabilities to the outcome, which is told by its place from 0."""
    return F.aggregate(F.transform(p, lambda x, i: F.pow(x - (i == outcome).cast("double"), F.lit(2.0))), F.lit(0.0), lambda a, x: a + x)


def multiclass_log_loss(p: Column, outcome: Column) -> Column:
    return -F.ln(F.greatest(F.get(p, outcome), F.lit(FLOOR)))


def implied_probability(money_line: Column) -> Column:
    """American odds to the probability they imply, the margin included."""
    return F.when(money_line < 0, -money_line / (-money_line + 100.0)).otherwise(100.0 / (money_line + 100.0))


def bayes_update(prior: Column, log_likelihoods: Column) -> Column:
    """Arrays of prior probabilities and log likelihoods to the posterior, shifted by the maximum. A prior of 0, or a
    log likelihood of minus infinity, stays at 0; likelihoods of infinity share all between them by their priors;
    where no outcome is possible the posterior is null."""
    certain = F.exists(F.zip_with(prior, log_likelihoods, lambda p, x: (p > 0) & (x == float("inf"))), lambda c: c)
    of_certain = F.zip_with(prior, log_likelihoods, lambda p, x: F.when((p > 0) & (x == float("inf")), p).otherwise(F.lit(0.0)))
    logs = F.zip_with(prior, log_likelihoods, lambda p, x: F.when(p > 0, F.ln(p) + x).otherwise(F.lit(float("-inf"))))
    shifted = lambda top: F.transform(logs, lambda x: F.when(x == float("-inf"), F.lit(0.0)).otherwise(F.exp(x - top)))
    weights = F.when(certain, of_certain).otherwise(let(F.array_max(logs), shifted))
    shared = lambda w: let(F.aggregate(w, F.lit(0.0), lambda a, x: a + x), lambda t: F.when(t > 0, F.transform(w, lambda x: x / t)))
    return let(weights, shared)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: within a lambda a plain expression is computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def softmax(values: Column) -> Column:
    total = lambda w: F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    shares = lambda w: let(total(w), lambda t: F.transform(w, lambda x: x / t))
    return let(F.array_max(values), lambda top: let(F.transform(values, lambda x: F.exp(x - top)), shares))


def argmax_label(labels: Column, probabilities: Column) -> Column:
    """The label of the largest probability, the first of equals."""
    return F.element_at(labels, F.array_position(probabilities, F.array_max(probabilities)).cast("int"))


def unsigned_zero(x: Column) -> Column:
    return F.when(x == 0, F.lit(0.0)).otherwise(x)
