"""Decision-policy arithmetic: prior shift, cost thresholds, review bands, expected cost."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def odds(p):
    return p / (1 - p)


def _num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def shift_probability(p: Column, prevalence, train_share) -> Column:
    """The probability of the same mail when the share of phishing changes from the training share."""
    clipped = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), p))
    shifted = odds(clipped) * odds(_num(prevalence)) / odds(_num(train_share))
    return shifted / (1 + shifted)


def cost_threshold(cost_ratio, prevalence, train_share) -> Column:
    return 1.0 / (1.0 + _num(cost_ratio) * odds(_num(prevalence)) / odds(_num(train_share)))


def review_band(cost_ratio, review_cost, prevalence, train_share) -> Column:
    """Struct (lo, hi) of the band sent to an analyst; null when review is too dear."""
    r, c = _num(cost_ratio), _num(review_cost)
    band = F.struct(shift_probability(c / r, train_share, prevalence).alias("lo"),
                    shift_probability(1 - c, train_share, prevalence).alias("hi"))
    return F.when(c < r / (1.0 + r), band)


def expected_cost(fnr, fpr, review_phishing, review_legit, cost_ratio, prevalence, review_cost=0.0) -> Column:
    """Cost per mail in units of one false alarm."""
    pi, r, c = _num(prevalence), _num(cost_ratio), _num(review_cost)
    return pi * (r * fnr + c * review_phishing) + (1 - pi) * (fpr + c * review_legit)


def trivial_cost(cost_ratio, prevalence) -> Column:
    return F.least(_num(prevalence) * _num(cost_ratio), 1 - _num(prevalence))


def relieved_threshold(verified: Column, suspicious: Column, t, t_verified) -> Column:
    """The higher bar only for verified senders without a suspicious sign."""
    return F.when(verified & ~suspicious, _num(t_verified)).otherwise(_num(t))


def hybrid_score(probability: Column, rule_score: Column, weight) -> Column:
    return _num(weight) * probability * 100 + (1 - _num(weight)) * F.least(rule_score.cast("double"), F.lit(100.0))


def platt(score: Column, slope, intercept) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), score))
    return 1.0 / (1.0 + F.exp(-(_num(slope) * F.ln(odds(p)) + _num(intercept))))
