"""Lambert-93 and WGS84 coordinates, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the conformal conic projection EPSG:2154 on the GRS80 ellipsoid.
AXIS, FLATTENING = 6378137.0, 1 / 298.257222101
LAT_0, LON_0, LAT_1, LAT_2, X_0, Y_0 = 46.5, 3.0, 49.0, 44.0, 700000.0, 6600000.0
E = math.sqrt(FLATTENING * (2 - FLATTENING))


def _m(lat: float) -> float:
    return math.cos(lat) / math.sqrt(1 - (E * math.sin(lat)) ** 2)


def _log_t(lat: float) -> float:
    """The isometric latitude, negated."""
    return math.log(math.tan(math.pi / 4 - lat / 2)) + E * math.atanh(E * math.sin(lat))


_ONE, _TWO = math.radians(LAT_1), math.radians(LAT_2)
CONE = (math.log(_m(_ONE)) - math.log(_m(_TWO))) / (_log_t(_ONE) - _log_t(_TWO))
SCALE = AXIS * _m(_ONE) / (CONE * math.exp(CONE * _log_t(_ONE)))
RHO_0 = SCALE * math.exp(CONE * _log_t(math.radians(LAT_0)))


def to_lambert93(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(x, y) in metres of degrees; null where the latitude is a pole or beyond."""
    phi = F.radians(lat)
    log_t = F.ln(F.tan(F.lit(math.pi / 4) - phi / 2)) + E * F.atanh(E * F.sin(phi))
    rho, theta = SCALE * F.exp(CONE * log_t), CONE * F.radians(lon - LON_0)
    good = F.abs(lat) < 90
    return F.when(good, X_0 + rho * F.sin(theta)), F.when(good, Y_0 + RHO_0 - rho * F.cos(theta))


def to_wgs84(x: Column, y: Column) -> tuple[Column, Column]:
    """(longitude, latitude) in degrees of metres. Six steps leave no error above that of doubles."""
    east, south = x - X_0, RHO_0 - (y - Y_0)
    log_t = F.ln(F.sqrt(east * east + south * south) / SCALE) / CONE
    phi = F.lit(math.pi / 2) - 2 * F.atan(F.exp(log_t))
    for _ in range(6):
        phi = F.lit(math.pi / 2) - 2 * F.atan(F.exp(log_t - E * F.atanh(E * F.sin(phi))))
    return LON_0 + F.degrees(F.atan2(east, south)) / CONE, F.degrees(phi)
