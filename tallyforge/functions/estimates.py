"""Column expressions of the estimates: decay, effective size, shrinkage, rates. Inputs are columns or names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed defaults of the analysis settings.
CONFIG = {
    "min_sample": 10.0,
    "prior_strength_k0": 24.0,
    "prior_strength_k1": 15.0,
    "synergy_max_size": 3.0,
    "self_decay_half_life": 2.0,
    "meta_decay_half_life": 2.0,
}
ENTITIES = 40
#: Effects below this many standard deviations carry no signal.
SIGNAL = 0.10


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def elapsed(patch_seq: Column | str, ref_seq: Column | str) -> Column:
    """Version boundaries between a contest and the reference point; before the first boundary counts as 0."""
    return F.abs(c(ref_seq) - F.coalesce(c(patch_seq), F.lit(0)))


def self_changes(change_count: Column | str, ref_count: Column | str) -> Column:
    return F.abs(F.coalesce(c(ref_count), F.lit(0)) - c(change_count))


def decay(self_distance: Column | str, elapsed_distance: Column | str, config: dict[str, float] = CONFIG) -> Column:
    """Half as much for every half-life of own changes and of elapsed boundaries. Negative distances are an error."""
    s, e = c(self_distance), c(elapsed_distance)
    w = F.pow(F.lit(0.5), s / config["self_decay_half_life"]) * F.pow(F.lit(0.5), e / config["meta_decay_half_life"])
    return F.when((s >= 0) & (e >= 0), w).otherwise(F.raise_error(F.lit("a distance is negative")))


def effective_size(weight: Column | str, square: Column | str) -> Column:
    return F.when(c(square) > 0, c(weight) * c(weight) / c(square)).otherwise(F.lit(0.0))


def shrink(wins: Column | str, weight: Column | str, target: Column | float, k: float) -> Column:
    """(wins + k * target) / (weight + k): the weighted rate pulled toward ``target``. Bad input is an error."""
    t = F.lit(target) if isinstance(target, (int, float)) else target
    good = (c(weight) >= 0) & (c(wins) >= 0) & (c(wins) <= c(weight) + 1e-9) & (t >= 0) & (t <= 1)
    if k < 0:
        raise ValueError("the prior strength is negative")
    return F.when(good, (c(wins) + k * t) / (c(weight) + F.lit(float(k)))).otherwise(F.raise_error(F.lit("not a tally")))


def rate(part: Column | str, whole: Column | str) -> Column:
    """part / whole to four decimals; null where whole is 0."""
    return F.when(c(whole) > 0, F.round(c(part) / c(whole), 4))


def validated(config: dict[str, float]) -> dict[str, float]:
    """The settings, if complete and in range; unknown keys are ignored."""
    missing = CONFIG.keys() - config.keys()
    if missing:
        raise ValueError(f"settings are missing: {sorted(missing)}")
    v = {k: float(config[k]) for k in CONFIG}
    if v["min_sample"] < 1 or min(v["prior_strength_k0"], v["prior_strength_k1"]) < 0 or not 2 <= v["synergy_max_size"] <= 3 or min(v["self_decay_half_life"], v["meta_decay_half_life"]) <= 0:
        raise ValueError("a setting is out of range")
    return v
