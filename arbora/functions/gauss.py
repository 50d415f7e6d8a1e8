"""Expressions over Gaussian concepts (count, mean, m2): variances, likelihoods, scores, would-be statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from arbora.functions.vec import as_col, total

# Results must agree with the engine being matched.
PRIOR_VAR = 1.0 / (2.0 * math.e * math.pi)
LN_2PI = math.log(2.0 * math.pi)
TWO_SQRT_PI = 2.0 * math.sqrt(math.pi)

SCORES = ("kl", "info", "ecg")


def variance(m2, n, acuity_cutoff: bool = False, prior: float = PRIOR_VAR) -> Column:
    n = as_col(n)
    if acuity_cutoff:
        return F.transform(as_col(m2), lambda s: F.greatest(s / n, F.lit(prior)))
    return F.transform(as_col(m2), lambda s: s / n + F.lit(prior))


def std(m2, n, **kw) -> Column:
    return F.transform(variance(m2, n, **kw), lambda v: F.sqrt(v))


def sq_diff(a, b) -> Column:
    return F.zip_with(as_col(a), as_col(b), lambda x, y: (x - y) * (x - y))


def log_prob(x, mean, var, with_2pi: bool = True) -> Column:
    quad = F.zip_with(sq_diff(x, mean), as_col(var), lambda d, v: d / v + F.log(v))
    body = total(quad)
    if with_2pi:
        body = body + F.size(as_col(var)) * F.lit(LN_2PI)
    return body * F.lit(-0.5)


def log_posterior(x, mean, var, count, root_count) -> Column:
    return log_prob(x, mean, var) + F.log(as_col(count)) - F.log(as_col(root_count))


def sum_log(v) -> Column:
    return F.aggregate(as_col(v), F.lit(0.0), lambda s, a: s + F.log(a))


def expected_correct(v) -> Column:
    """Sum over dimensions of 1 / (2 sqrt(pi) sd)."""
    return F.aggregate(as_col(v), F.lit(0.0), lambda s, a: s + F.lit(1.0) / (F.lit(TWO_SQRT_PI) * F.sqrt(a)))


def score(mean1, var1, mean2, var2, kind: str = "kl") -> Column:
    """How much concept 1 says beyond concept 2, by Gaussian KL, log-variance or expected correct guesses."""
    if kind == "kl":
        spread = F.zip_with(sq_diff(mean1, mean2), as_col(var1), lambda d, v: d + v)
        ratio = total(F.zip_with(spread, as_col(var2), lambda s, v: s / v + F.log(v)))
        return (ratio - sum_log(var1) - F.size(as_col(var1))) * F.lit(0.5)
    if kind == "info":
        return (sum_log(var2) - sum_log(var1)) * F.lit(0.5)
    if kind == "ecg":
        return expected_correct(var2) - expected_correct(var1)
    raise ValueError(f"unknown score kind: {kind}")


def label_term(p1, p2, kind: str = "kl") -> Column:
    """What the label distributions add to ``score``; p1 and p2 are aligned arrays of smoothed probabilities."""
    p1, p2 = as_col(p1), as_col(p2)
    neg_self = lambda p: total(F.transform(p, lambda a: -a * F.log(a)))
    if kind == "kl":
        return neg_self(p1) - total(F.zip_with(p1, p2, lambda a, b: -a * F.log(b)))
    if kind == "info":
        return neg_self(p1) - neg_self(p2)
    if kind == "ecg":
        return total(F.transform(p2, lambda b: b * b)) - total(F.transform(p1, lambda a: a * a))
    raise ValueError(f"unknown score kind: {kind}")


# ---- would-be statistics: nothing is written to the tree -------------------------------------------------


def insert_mean(x, mean, n) -> Column:
    n = as_col(n)
    return F.zip_with(as_col(x), as_col(mean), lambda a, m: m + (a - m) / (n + 1))


def insert_m2(x, mean, m2, n) -> Column:
    """m2 after one more row: m2 + (x - mean)^2 n / (n + 1)."""
    n = as_col(n)
    return F.zip_with(sq_diff(x, mean), as_col(m2), lambda d, s: s + d * (n / (n + 1)))


def merged_mean(mean_a, n_a, mean_b, n_b) -> Column:
    n_a, n_b = as_col(n_a), as_col(n_b)
    return F.zip_with(as_col(mean_a), as_col(mean_b), lambda a, b: (n_a * a + n_b * b) / (n_a + n_b))


def merged_m2(mean_a, m2_a, n_a, mean_b, m2_b, n_b) -> Column:
    n_a, n_b = as_col(n_a), as_col(n_b)
    pooled = F.zip_with(as_col(m2_a), as_col(m2_b), lambda a, b: a + b)
    return F.zip_with(pooled, sq_diff(mean_a, mean_b), lambda s, d: s + d * (n_a * n_b / (n_a + n_b)))


def prior_variance_like(vec, prior: float = PRIOR_VAR) -> Column:
    return F.array_repeat(F.lit(prior), F.size(as_col(vec)))


def score_after_insert(x, mean, m2, n, kind: str = "kl") -> Column:
    """Own score of a node after one more row: a quarter of the summed log variance, or minus expected correct."""
    var = variance(insert_m2(x, mean, m2, n), as_col(n) + 1)
    return -expected_correct(var) if kind == "ecg" else sum_log(var) * F.lit(0.25)


def score_after_merge(x, a: dict, b: dict, kind: str = "kl") -> Column:
    """Own score of the union of two nodes plus one row: half of the summed log variance, or minus expected correct."""
    n = as_col(a["count"]) + as_col(b["count"])
    mean = merged_mean(a["mean"], a["count"], b["mean"], b["count"])
    m2 = merged_m2(a["mean"], a["m2"], a["count"], b["mean"], b["m2"], b["count"])
    var = variance(insert_m2(x, mean, m2, n), n + 1)
    return -expected_correct(var) if kind == "ecg" else sum_log(var) * F.lit(0.5)
