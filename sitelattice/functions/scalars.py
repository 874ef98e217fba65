"""Column expressions for cleaning, scaling and scoring."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def as_number(c: Column) -> Column:
    """Numeric coercion; anything unparseable becomes NULL."""
    return c.try_cast("double")


def percent_number(c: Column) -> Column:
    """Numeric text that may carry a trailing percent sign; blanks become NULL."""
    return F.rtrim(F.trim(c), F.lit("%")).try_cast("double")


def without_sentinels(c: Column, sentinels) -> Column:
    """Numeric value, NULL where the text is one of the column's missing-value codes."""
    t = F.trim(c.cast("string"))
    return F.when(~t.isin(*[str(s) for s in sentinels]), t).try_cast("double")


def expit(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi)))


def logit(p: Column, eps: float = EPS) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1.0 - q))


def softplus(z: Column) -> Column:
    """log(1 + exp(z)) without overflow."""
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def age_in_years(birth: Column, at: Column, oldest: float = 120.0, capped: float = 90.0) -> Column:
    """Year difference; shifted birth dates that give absurd ages are set to the cap."""
    a = (F.year(at) - F.year(birth)).cast("double")
    return F.when(a > oldest, F.lit(capped)).otherwise(a)


def age_from_text(c: Column, top: str = "> 89", value: float = 90.0) -> Column:
    return F.when(F.trim(c) == top, F.lit(value)).otherwise(c.try_cast("double"))


def hours_between(start: str, end: str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.col(start), F.col(end)) / 3.6e9


def horizon_outcome(stat: Column, days: Column, horizon: float = 1826.0) -> Column:
    """1 if the event came by the horizon, 0 if followed past it, NULL if unknown."""
    return (F.when(days > horizon, F.lit(0))
            .when((stat == 1) & (days <= horizon), F.lit(1)))


def ordinal_letter(c: Column, letters: str = "ABCDEFG") -> Column:
    pos = F.instr(F.lit(letters), F.upper(F.trim(c)))
    return F.when((pos > 0) & (F.length(F.trim(c)) == 1), (pos - 1).cast("double"))


def normalised_label(c: Column) -> Column:
    """Lower case, punctuation to blanks, blanks squeezed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(c), ",.()-/", "      "), r"\s+", " "))


def trailing_digits(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d+)$", 1)


def station_of(c: Column) -> Column:
    """``L0_S12_F345`` -> ``L0_S12``."""
    return F.regexp_extract(c, r"^([^_]+_[^_]+)_", 1)


def shrink_weight(n: Column, kappa) -> Column:
    """n / (n + kappa), zero when both vanish."""
    k = kappa if isinstance(kappa, Column) else F.lit(float(kappa))
    return F.when(n + k > 0, n / (n + k)).otherwise(F.lit(0.0))


def symmetric_log(y: Column, linear: float = 20.0) -> Column:
    """Linear inside +-linear, logarithmic outside, continuous at the joint."""
    mag = F.abs(y)
    return F.signum(y) * F.when(mag <= linear, mag / linear).otherwise(1.0 + F.log10(
        F.greatest(mag, F.lit(linear)) / linear))


def unit_ball(cols: list[Column]) -> list[Column]:
    """Scale a row into the unit ball; rows already inside stay as they are."""
    norm = F.sqrt(sum((c * c for c in cols[1:]), cols[0] * cols[0]))
    return [c / F.greatest(norm, F.lit(1.0)) for c in cols]


def gaussian_sigma(sensitivity: float, eps: float, delta: float = 1e-5) -> float:
    """Noise scale of the Gaussian mechanism; no noise at infinite epsilon."""
    if math.isinf(eps):
        return 0.0
    return sensitivity * math.sqrt(2.0 * math.log(1.25 / delta)) / eps


def per_round_epsilon(eps_total: float, rounds: int, delta: float = 1e-5) -> float:
    """Budget of one of ``rounds`` releases: the better of basic and advanced composition."""
    if math.isinf(eps_total) or rounds <= 1:
        return eps_total
    slack = math.sqrt(2 * rounds * math.log(2.0 / delta))
    lo, hi = 0.0, float(eps_total)
    for _ in range(100):
        mid = (lo + hi) / 2
        if slack * mid + rounds * mid * math.expm1(mid) < eps_total:
            lo = mid
        else:
            hi = mid
    return max(eps_total / rounds, lo)
