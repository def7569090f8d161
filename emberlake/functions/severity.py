"""Severity on the common 1..4 scale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hectare and magnitude thresholds, warning levels.
BURNT_AREA_STEPS = ((5000.0, 4), (500.0, 3))
MAGNITUDE_STEPS = ((5.5, 4), (4.0, 3), (3.0, 2))
WARNING_LEVELS = {"verde": 1, "amarillo": 2, "naranja": 3, "rojo": 4}


def _steps(value: Column, steps, floor: int) -> Column:
    out = F.lit(floor)
    for bound, level in sorted(steps):
        out = F.when(value >= F.lit(bound), F.lit(level)).otherwise(out)
    return out.cast("smallint")


def wildfire_severity(kind: Column, area_ha: Column) -> Column:
    """2 for a hotspot; a burnt area grows with its hectares; any other kind is an error."""
    return (
        F.when(kind == "hotspot", F.lit(2).cast("smallint"))
        .when(kind == "burnt_area", _steps(area_ha, BURNT_AREA_STEPS, 2))
        .otherwise(
            F.raise_error(F.concat(F.lit("unknown wildfire kind: "), F.coalesce(kind, F.lit("NULL"))))
        )
    )


def quake_severity(magnitude: Column) -> Column:
    return _steps(magnitude, MAGNITUDE_STEPS, 1)


def _level_key(level: Column) -> Column:
    return F.lower(F.trim(level))


def known_level(level: Column) -> Column:
    return F.coalesce(_level_key(level).isin(*WARNING_LEVELS), F.lit(False))


def warning_severity(level: Column) -> Column:
    """Level name to 1..4, blanks and case ignored; an unknown level is an error."""
    key = _level_key(level)
    out = F.raise_error(F.concat(F.lit("unknown warning level: "), F.coalesce(level, F.lit("NULL"))))
    for name, rank in WARNING_LEVELS.items():
        out = F.when(key == name, F.lit(rank).cast("smallint")).otherwise(out)
    return out
