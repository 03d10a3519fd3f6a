"""Coordinate transforms as chains of native projections.

Geographic coordinates (EPSG:4326), conterminous Albers (EPSG:5070) and interrupted Goode
homolosine. Formulas follow Snyder, "Map projections: a working manual", USGS PP 1395 (1987).
Iterations are folds (``aggregate`` over a fixed number of steps).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame

GEOGRAPHIC = "EPSG:4326"
ALBERS = "EPSG:5070"
GOODE = "IGH"

# The GRS 80 ellipsoid and the parameters of EPSG:5070.
GRS80_A = 6378137.0
GRS80_F = 1 / 298.257222101
ALBERS_LAT_1, ALBERS_LAT_2, ALBERS_LAT_0, ALBERS_LON_0 = 29.5, 45.5, 23.0, -96.0

# Goode homolosine on a sphere; seam latitude, vertical shift of the outer part in
# radii, and the lobes (south, north, west limit, east limit, central meridian) in degrees.
GOODE_R = 6378137.0
GOODE_SEAM = 40 + 44 / 60 + 11.8 / 3600
GOODE_SHIFT = 0.0528035274542
GOODE_NORTH = ((-180, -40, -100), (-40, 180, 30))
GOODE_SOUTH = ((-180, -100, -160), (-100, -20, -60), (-20, 80, 20), (80, 180, 140))

NEWTON_STEPS = 8
LATITUDE_STEPS = 6


@dataclass(frozen=True)
class AlbersCone:
    """Constants of an ellipsoidal Albers projection; latitudes and longitude in degrees."""

    a: float = GRS80_A
    e2: float = GRS80_F * (2 - GRS80_F)
    lat1: float = ALBERS_LAT_1
    lat2: float = ALBERS_LAT_2
    lat0: float = ALBERS_LAT_0
    lon0: float = ALBERS_LON_0

    @property
    def e(self) -> float:
        return math.sqrt(self.e2)

    def q(self, lat: float) -> float:
        s = math.sin(math.radians(lat))
        es = self.e * s
        return (1 - self.e2) * (s / (1 - es * es) - math.log((1 - es) / (1 + es)) / (2 * self.e))

    def m2(self, lat: float) -> float:
        s = math.sin(math.radians(lat))
        return (1 - s * s) / (1 - self.e2 * s * s)

    @property
    def n(self) -> float:
        return (self.m2(self.lat1) - self.m2(self.lat2)) / (self.q(self.lat2) - self.q(self.lat1))

    @property
    def c(self) -> float:
        return self.m2(self.lat1) + self.n * self.q(self.lat1)

    @property
    def rho0(self) -> float:
        return self.a * math.sqrt(self.c - self.n * self.q(self.lat0)) / self.n


def _n(value: float) -> str:
    """A double literal."""
    return f"({float(value)!r}D)"


def _steps(df: DataFrame, x: str, y: str, *steps: dict[str, str]) -> DataFrame:
    """Successive projections of SQL expressions; the last one gives the new ``x`` and ``y``.

    Each step sees the old coordinates as ``_x`` and ``_y`` and the results of earlier steps.
    """
    keep = [f"`{c}`" for c in df.columns if c not in (x, y)]
    df = df.selectExpr(*keep, f"`{x}` as _x", f"`{y}` as _y")
    seen = ["_x", "_y"]
    for step in steps[:-1]:
        df = df.selectExpr(*keep, *seen, *[f"{text} as {name}" for name, text in step.items()])
        seen += step
    # A generator of one row: later filters on the new coordinates stay above it, so the formulas
    # are computed once and are never copied into other expressions.
    last = steps[-1]
    return df.selectExpr(*keep, f"inline(array(named_struct('x', {last['x']}, 'y', {last['y']}))) as (`{x}`, `{y}`)")


def _iterate(start: str, improve: str, steps: int) -> str:
    """Apply ``improve``, an expression in ``t``, a fixed number of times."""
    return f"aggregate(sequence(1, {steps}), {start}, (t, i) -> {improve})"


def _log_ratio(sine: str, e: float) -> str:
    return f"ln((1 - {_n(e)} * {sine}) / (1 + {_n(e)} * {sine})) / {_n(2 * e)}"


def to_albers(df: DataFrame, x: str = "x", y: str = "y", cone: AlbersCone = AlbersCone()) -> DataFrame:
    """Replace longitude/latitude in degrees by Albers metres."""
    return _steps(
        df,
        x,
        y,
        {"_s": "sin(radians(_y))", "_t": f"{_n(cone.n)} * radians(_x - {_n(cone.lon0)})"},
        {"_q": f"{_n(1 - cone.e2)} * (_s / (1 - {_n(cone.e2)} * _s * _s) - {_log_ratio('_s', cone.e)})"},
        {"_r": f"{_n(cone.a)} * sqrt({_n(cone.c)} - {_n(cone.n)} * _q) / {_n(cone.n)}"},
        {"x": "_r * sin(_t)", "y": f"{_n(cone.rho0)} - _r * cos(_t)"},
    )


def from_albers(df: DataFrame, x: str = "x", y: str = "y", cone: AlbersCone = AlbersCone()) -> DataFrame:
    """Replace Albers metres by longitude/latitude in degrees."""
    w = f"(1 - {_n(cone.e2)} * sin(t) * sin(t))"
    gap = f"(_q / {_n(1 - cone.e2)} - sin(t) / {w} + {_log_ratio('sin(t)', cone.e)})"
    return _steps(
        df,
        x,
        y,
        {"_d": f"{_n(cone.rho0)} - _y"},
        {"_q": f"({_n(cone.c)} - (_x * _x + _d * _d) * {_n(cone.n**2 / cone.a**2)}) / {_n(cone.n)}"},
        {"_p": _iterate("asin(_q / 2)", f"t + {w} * {w} / (2 * cos(t)) * {gap}", LATITUDE_STEPS)},
        {"x": f"{_n(cone.lon0)} + degrees(atan2(_x, _d) / {_n(cone.n)})", "y": "degrees(_p)"},
    )


def _lobe(lon: str, north: str) -> str:
    """Central meridian (degrees) of the lobe that holds a longitude."""

    def pick(lobes):
        bounds = " ".join(f"when {lon} <= {east} then {_n(centre)}" for _, east, centre in lobes[:-1])
        return f"case {bounds} else {_n(lobes[-1][2])} end"

    return f"case when {north} then {pick(GOODE_NORTH)} else {pick(GOODE_SOUTH)} end"


def to_goode(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Replace longitude/latitude in degrees by interrupted Goode homolosine metres."""
    inner = f"abs(_y) <= {_n(GOODE_SEAM)}"
    # 2t + sin 2t = pi sin(phi), with d/dt = 2 + 2 cos 2t; flat at the poles, where t = phi.
    slope = "(2 + 2 * cos(2 * t))"
    newton = f"if({slope} > 1e-12D, t - (2 * t + sin(2 * t) - pi() * sin(_p)) / {slope}, t)"
    return _steps(
        df,
        x,
        y,
        {"_p": "radians(_y)", "_c": _lobe("_x", "_y >= 0")},
        {"_t": _iterate("_p", newton, NEWTON_STEPS), "_l": "radians(_x - _c)"},
        {
            "x": f"{_n(GOODE_R)} * (radians(_c) + _l * "
            f"case when {inner} then cos(_p) else {_n(2 * math.sqrt(2) / math.pi)} * cos(_t) end)",
            "y": f"{_n(GOODE_R)} * case when {inner} then _p "
            f"else {_n(math.sqrt(2))} * sin(_t) - {_n(GOODE_SHIFT)} * signum(_p) end",
        },
    )


def from_goode(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Replace interrupted Goode homolosine metres by longitude/latitude in degrees."""
    inner = f"abs(_v) <= {_n(math.radians(GOODE_SEAM))}"
    return _steps(
        df,
        x,
        y,
        {"_u": f"_x / {_n(GOODE_R)}", "_v": f"_y / {_n(GOODE_R)}"},
        {
            "_c": f"radians({_lobe('degrees(_u)', '_v >= 0')})",
            "_t": f"asin((_v + {_n(GOODE_SHIFT)} * signum(_v)) / {_n(math.sqrt(2))})",
        },
        {"_p": f"case when {inner} then _v else asin((2 * _t + sin(2 * _t)) / pi()) end"},
        {
            "x": "degrees(_c + (_u - _c) / "
            f"case when {inner} then cos(_p) else {_n(2 * math.sqrt(2) / math.pi)} * cos(_t) end)",
            "y": "degrees(_p)",
        },
    )


_TO_GEOGRAPHIC = {GEOGRAPHIC: lambda df, x, y: df, ALBERS: from_albers, GOODE: from_goode}
_FROM_GEOGRAPHIC = {GEOGRAPHIC: lambda df, x, y: df, ALBERS: to_albers, GOODE: to_goode}


def reproject(df: DataFrame, source: str, target: str, x: str = "x", y: str = "y") -> DataFrame:
    """Transform coordinate columns between two of the supported reference systems."""
    if source == target:
        return df
    return _FROM_GEOGRAPHIC[target](_TO_GEOGRAPHIC[source](df, x, y), x, y)
