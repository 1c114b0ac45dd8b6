"""Per-cell terrain functions: classes, sectors, exposures, scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
SLOPE_LIMITS = (5.0, 15.0, 25.0)
SLOPE_NAMES = ("flat", "moderate", "steep", "very_steep")
SECTORS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")
BUILDABILITY = ("excellent", "good", "difficult", "unsuitable")


def slope_class(percent: Column, limits: tuple[float, ...] = SLOPE_LIMITS) -> Column:
    """0, 1, 2, ... as the slope reaches each limit; no slope reaches none."""
    return reduce(lambda a, b: a + F.coalesce((percent >= b).cast("int"), F.lit(0)), limits, F.lit(0))


def named(code: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), code + 1)


def sector_code(aspect: Column) -> Column:
    """0 flat (below zero), else 1 to 8 clockwise from north."""
    return F.when(aspect < 0, 0).otherwise(F.pmod(F.floor((aspect + 22.5) / 45.0), F.lit(8)).cast("int") + 1)


def sector_name(code: Column) -> Column:
    return named(code, ("FLAT", *SECTORS))


def _toward(aspect: Column, best: Column) -> Column:
    return (F.cos(F.radians(aspect - best)) + 1.0) / 2.0


def solar_exposure(aspect: Column, slope: Column, latitude: float) -> Column:
    best = F.lit(180.0 if latitude >= 0 else 0.0)
    return F.when(aspect < 0, 0.5).otherwise(_toward(aspect, best) * F.exp(-F.abs(slope - abs(latitude)) / 30.0))


def wind_exposure(aspect: Column, slope: Column, direction: float) -> Column:
    return F.when(aspect < 0, 0.3).otherwise(_toward(aspect, F.lit(direction)) * (0.7 + 0.3 * F.tanh(slope / 30.0)))


def buildability_class(mean_slope: Column) -> Column:
    return F.when(mean_slope <= 5.0, BUILDABILITY[0]).when(mean_slope <= 15.0, BUILDABILITY[1]).when(mean_slope <= 25.0, BUILDABILITY[2]).otherwise(BUILDABILITY[3])


def zone_quality(area: Column, mean_slope: Column, compactness: Column, level: Column) -> Column:
    bonus = F.when(level == BUILDABILITY[0], 10.0).when(level == BUILDABILITY[1], 7.0).when(level == BUILDABILITY[2], 3.0).otherwise(0.0)
    score = F.least(area / 5000.0, F.lit(1.0)) * 30.0 + F.greatest(F.lit(0.0), 1.0 - mean_slope / 25.0) * 40.0 + compactness * 20.0 + bonus
    return F.least(score, F.lit(100.0))
