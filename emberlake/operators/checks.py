"""Argument checks, raised when an operator is built and before any job runs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Limits:
    """Ceilings of the arguments. The defaults are fixed values; ``overridden`` sets others."""

    max_radius_m: float = 200_000
    max_min_points: int = 1000
    max_limit: int = 1000
    years: tuple[int, int] = (2000, 2100)
    magnitudes: tuple[float, float] = (0, 10)
    unbounded_clusters: bool = False


_limits: ContextVar[Limits] = ContextVar("limits", default=Limits())


@contextmanager
def overridden(**ceilings) -> Iterator[Limits]:
    """Other ceilings for the operators built inside the block, for larger jobs or older data."""
    token = _limits.set(replace(_limits.get(), **ceilings))
    try:
        yield _limits.get()
    finally:
        _limits.reset(token)


# Forms of codes.
PROVINCE_PATTERN = r"\d{2}"
PHENOMENON_PATTERN = r"[A-Z]{2}"


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def bbox(box) -> tuple[float, float, float, float]:
    _require(len(box) == 4, "bbox is (min_lon, min_lat, max_lon, max_lat)")
    minx, miny, maxx, maxy = (float(v) for v in box)
    _require(-180 <= minx < maxx <= 180, "bbox needs -180 <= min_lon < max_lon <= 180")
    _require(-90 <= miny < maxy <= 90, "bbox needs -90 <= min_lat < max_lat <= 90")
    return minx, miny, maxx, maxy


def centre(lon: float, lat: float) -> None:
    _require(-180 <= lon <= 180 and -90 <= lat <= 90, "centre lies outside the lon/lat ranges")


def metres(value: float, name: str) -> None:
    most = _limits.get().max_radius_m
    _require(0 < value <= most, f"{name} must be in (0, {most}]")


def min_points(value: int) -> None:
    most = _limits.get().max_min_points
    _require(1 <= value <= most, f"min_points must be in 1..{most}")


def cluster_bound(filters: dict) -> None:
    bounded = any(filters.get(name) is not None for name in ("bbox", "starts_after"))
    _require(
        bounded or _limits.get().unbounded_clusters, "clusters need a bounding filter: bbox or starts_after"
    )


def limit(value: int) -> None:
    most = _limits.get().max_limit
    _require(1 <= value <= most, f"limit must be in 1..{most}")


def severity(value: int) -> None:
    _require(1 <= value <= 4, "severity must be in 1..4")


def year(value: int) -> None:
    first, last = _limits.get().years
    _require(first <= value <= last, f"year must be in {first}..{last}")


def min_magnitude(value: float | None) -> None:
    least, most = _limits.get().magnitudes
    _require(value is None or least <= value <= most, f"minimum magnitude must be in {least}..{most}")


def province_code(value: str | None) -> None:
    _require(
        value is None or re.fullmatch(PROVINCE_PATTERN, value) is not None,
        "province code is two digits",
    )


def phenomenon_code(value: str | None) -> None:
    _require(
        value is None or re.fullmatch(PHENOMENON_PATTERN, value) is not None,
        "phenomenon code is two capital letters",
    )
