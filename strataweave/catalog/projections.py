"""Coordinate transforms and raster steps in SQL, written from the published formulas.

Each function wraps a query in further selects; helper columns start with ``z``.
"""

from __future__ import annotations

# Ellipsoid and standard parallels as in the forward and inverse formulas 14-1 to 14-15 and 3-12 to 3-16.
CONE = """SELECT *, (m1 * m1 - m2 * m2) / (q2 - q1) AS n, m1 * m1 + (m1 * m1 - m2 * m2) / (q2 - q1) * q1 AS c,
  6378137::DOUBLE * sqrt(m1 * m1 + (m1 * m1 - m2 * m2) / (q2 - q1) * (q1 - q0)) / ((m1 * m1 - m2 * m2) / (q2 - q1)) AS rho0
FROM (SELECT e2, sqrt(e2) AS e,
  cos(radians(29.5)) / sqrt(1 - e2 * pow(sin(radians(29.5)), 2)) AS m1,
  cos(radians(45.5)) / sqrt(1 - e2 * pow(sin(radians(45.5)), 2)) AS m2,
  {q1} AS q1, {q2} AS q2, {q0} AS q0
  FROM (SELECT f * (2 - f) AS e2 FROM (SELECT 1::DOUBLE / 298.257222101::DOUBLE AS f)))"""


def _q(sine: str) -> str:
    e = "sqrt(e2)"
    return (
        f"(1 - e2) * ({sine} / (1 - e2 * {sine} * {sine}) - ln((1 - {e} * {sine}) / (1 + {e} * {sine})) / (2 * {e}))"
    )


CONE = CONE.format(q1=_q("sin(radians(29.5))"), q2=_q("sin(radians(45.5))"), q0=_q("sin(radians(23))"))


def sql_to_albers(source: str, lon: str, lat: str, x: str = "x", y: str = "y") -> str:
    """Add Albers metres; needs the query ``cone``."""
    return f"""SELECT * EXCLUDE (zs, zt, zr, e2, e, m1, m2, q0, q1, q2, n, c, rho0), zr * sin(zt) AS {x}, rho0 - zr * cos(zt) AS {y}
  FROM (SELECT *, 6378137::DOUBLE * sqrt(c - n * ({_q("zs")})) / n AS zr
  FROM (SELECT s.*, cone.*, sin(radians({lat})) AS zs, n * radians({lon} + 96) AS zt FROM {source} s, cone))"""


def sql_from_albers(source: str, x: str, y: str, lon: str = "lon", lat: str = "lat", steps: int = 6) -> str:
    """Add longitude and latitude from Albers metres; needs the query ``cone``."""
    inner = f"""SELECT *, asin(zq / 2) AS zp FROM (SELECT *, (c - zr * n * n / (6378137::DOUBLE * 6378137)) / n AS zq
  FROM (SELECT s.*, cone.*, {x} * {x} + (rho0 - {y}) * (rho0 - {y}) AS zr, atan2({x}, rho0 - {y}) AS zt FROM {source} s, cone))"""
    for _ in range(steps):
        inner = f"""SELECT * REPLACE (zp + pow(1 - e2 * sin(zp) * sin(zp), 2) / (2 * cos(zp)) * (zq / (1 - e2)
  - sin(zp) / (1 - e2 * sin(zp) * sin(zp)) + ln((1 - e * sin(zp)) / (1 + e * sin(zp))) / (2 * e)) AS zp) FROM ({inner})"""
    return f"""SELECT * EXCLUDE (zr, zt, zq, zp, e2, e, m1, m2, q0, q1, q2, n, c, rho0),
  -96 + degrees(zt / n) AS {lon}, degrees(zp) AS {lat} FROM ({inner})"""


_SEAM = "(40 + 44 / 60::DOUBLE + 11.8 / 3600::DOUBLE)"


def _centre(lon: str, north: str) -> str:
    return f"""CASE WHEN {north} THEN CASE WHEN {lon} <= -40 THEN -100 ELSE 30 END
  ELSE CASE WHEN {lon} <= -100 THEN -160 WHEN {lon} <= -20 THEN -60 WHEN {lon} <= 80 THEN 20 ELSE 140 END END"""


def sql_to_goode(source: str, lon: str, lat: str, x: str = "x", y: str = "y", steps: int = 8) -> str:
    """Add interrupted homolosine metres; the outer part by Newton steps."""
    inner = f"""SELECT *, radians({lat}) AS zp, radians({lat}) AS zt, {_centre(lon, f"{lat} >= 0")} AS zc FROM {source}"""
    for _ in range(steps):
        inner = f"SELECT * REPLACE (zt - (2 * zt + sin(2 * zt) - pi() * sin(zp)) / (2 + 2 * cos(2 * zt)) AS zt) FROM ({inner})"
    return f"""SELECT * EXCLUDE (zp, zt, zc), 6378137::DOUBLE * (radians(zc) + radians({lon} - zc) * CASE
  WHEN abs({lat}) <= {_SEAM} THEN cos(zp) ELSE 2 * sqrt(2) / pi() * cos(zt) END) AS {x},
  6378137::DOUBLE * CASE WHEN abs({lat}) <= {_SEAM} THEN zp
  ELSE sqrt(2) * sin(zt) - 0.0528035274542::DOUBLE * sign(zp) END AS {y} FROM ({inner})"""


def sql_from_goode(source: str, x: str, y: str, lon: str = "lon", lat: str = "lat") -> str:
    """Add longitude and latitude from interrupted homolosine metres."""
    return f"""SELECT * EXCLUDE (zu, zv, zc, zt, zp), degrees(radians(zc) + (zu - radians(zc)) / CASE
  WHEN abs(zv) <= radians({_SEAM}) THEN cos(zp) ELSE 2 * sqrt(2) / pi() * cos(zt) END) AS {lon}, degrees(zp) AS {lat}
  FROM (SELECT *, CASE WHEN abs(zv) <= radians({_SEAM}) THEN zv ELSE asin((2 * zt + sin(2 * zt)) / pi()) END AS zp
  FROM (SELECT *, {_centre("degrees(zu)", "zv >= 0")} AS zc,
  asin((zv + 0.0528035274542::DOUBLE * sign(zv)) / sqrt(2)) AS zt
  FROM (SELECT *, {x} / 6378137::DOUBLE AS zu, {y} / 6378137::DOUBLE AS zv FROM {source})))"""


# Target grid of the warped layers: the transformed outline of the source grid, widened to whole kilometres.
_OUTLINE = """SELECT -125 + 59 * i / 200::DOUBLE AS lon, v.lat::DOUBLE AS lat FROM range(0, 201) r(i), (VALUES (24), (49)) v(lat)
  UNION ALL SELECT v.lon::DOUBLE, 24 + 25 * i / 200::DOUBLE FROM range(0, 201) r(i), (VALUES (-125), (-66)) v(lon)"""
_ALBERS_BOX = f"""SELECT floor(min(x) / 1000) * 1000 AS tx0, ceil(max(x) / 1000) * 1000 AS tx1, floor(min(y) / 1000) * 1000 AS ty0,
  ceil(max(y) / 1000) * 1000 AS ty1 FROM ({sql_to_albers("outline", "lon", "lat")})"""
ALBERS_CELLS = """SELECT row, col, tx0 + (col + 0.5::DOUBLE) * ((tx1 - tx0) / 50) AS x,
  ty1 - (row + 0.5::DOUBLE) * ((ty1 - ty0) / nrow) AS y
  FROM albers_box, (SELECT CAST(i // 50 AS INT) AS row, CAST(i % 50 AS INT) AS col, nrow
  FROM (SELECT unnest(range(0, nrow * 50)) AS i, nrow FROM grid))"""


def warp_steps(cells: str) -> dict[str, str]:
    """Named queries ending in ``warped``: bilinear values of ``cells`` on the Albers grid."""
    return {
        "cone": CONE,
        "outline": _OUTLINE,
        "albers_box": _ALBERS_BOX,
        "target": ALBERS_CELLS,
        "carried": sql_from_albers("target", "x", "y"),
        "framed": "SELECT *, (lon + 125) / xres - 0.5 AS fx, (49 - lat) / yres - 0.5 AS fy FROM carried, grid",
        "asked": """SELECT row, col, x, y, floor(fy)::INT + dr AS nr, floor(fx)::INT + dc AS nc,
  (CASE dr WHEN 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END)
  * (CASE dc WHEN 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) AS w
  FROM framed, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(dr, dc)""",
        "warped": f"""SELECT a.row, a.col, a.x, a.y, sum(w * s.value) / sum(w) AS value FROM asked a
  JOIN {cells} s ON s.row = a.nr AND s.col = a.nc WHERE w > 0 AND s.value IS NOT NULL GROUP BY a.row, a.col, a.x, a.y""",
    }
