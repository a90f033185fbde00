"""WGS84 geodesy as column expressions: geodetic, ECEF, local tangent plane, UTM."""

from __future__ import annotations

from math import cos, radians, sin, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS84 ellipsoid.
A = 6378137.0
INV_F = 298.257223563
FLAT = 1 / INV_F
B = A * (1 - FLAT)
E2 = FLAT * (2 - FLAT)
EP2 = E2 / (1 - E2)


def ecef(lat: Column, lon: Column, alt: Column) -> tuple[Column, Column, Column]:
    """Geodetic degrees and metres to earth-centred metres."""
    phi, lam = F.radians(lat), F.radians(lon)
    n = F.lit(A) / F.sqrt(1 - E2 * F.sin(phi) * F.sin(phi))
    return (n + alt) * F.cos(phi) * F.cos(lam), (n + alt) * F.cos(phi) * F.sin(lam), (n * (1 - E2) + alt) * F.sin(phi)


def geodetic(x: Column, y: Column, z: Column, rounds: int = 8) -> tuple[Column, Column, Column]:
    """Earth-centred metres to geodetic degrees and metres, by a fixed number of latitude refinements; on the axis the height is along it."""
    p = F.hypot(x, y)
    start = F.atan2(z, p * (1 - E2))

    def refine(phi: Column, _: Column) -> Column:
        n = F.lit(A) / F.sqrt(1 - E2 * F.sin(phi) * F.sin(phi))
        return F.atan2(z + E2 * n * F.sin(phi), p)

    phi = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, refine)
    n = F.lit(A) / F.sqrt(1 - E2 * F.sin(phi) * F.sin(phi))
    alt = F.when(p > 1e-6, F.when(F.abs(F.cos(phi)) > 0.5, p / F.cos(phi) - n).otherwise(z / F.sin(phi) - n * (1 - E2))).otherwise(F.abs(z) - B)
    return F.degrees(phi), F.degrees(F.atan2(y, x)), alt


def enu_basis(lat0: float, lon0: float) -> list[list[float]]:
    """Rows east, north and up of the rotation from earth-centred to local axes."""
    sp, cp, sl, cl = sin(radians(lat0)), cos(radians(lat0)), sin(radians(lon0)), cos(radians(lon0))
    return [[-sl, cl, 0.0], [-sp * cl, -sp * sl, cp], [cp * cl, cp * sl, sp]]


def ecef_of(lat: float, lon: float, alt: float) -> tuple[float, float, float]:
    s, c = sin(radians(lat)), cos(radians(lat))
    n = A / sqrt(1 - E2 * s * s)
    return (n + alt) * c * cos(radians(lon)), (n + alt) * c * sin(radians(lon)), (n * (1 - E2) + alt) * s


class TangentPlane:
    """A local east-north-up frame about a geodetic origin, both ways."""

    def __init__(self, lat0: float, lon0: float, alt0: float = 0.0):
        self.lat0, self.lon0, self.alt0 = lat0, lon0, alt0
        self.basis, self.origin = enu_basis(lat0, lon0), ecef_of(lat0, lon0, alt0)

    def to_enu(self, lat: Column, lon: Column, alt: Column) -> tuple[Column, Column, Column]:
        d = [c - o for c, o in zip(ecef(lat, lon, alt), self.origin)]
        return tuple(r[0] * d[0] + r[1] * d[1] + r[2] * d[2] for r in self.basis)

    def to_geodetic(self, e: Column, n: Column, u: Column) -> tuple[Column, Column, Column]:
        b = self.basis
        return geodetic(*(b[0][i] * e + b[1][i] * n + b[2][i] * u + self.origin[i] for i in range(3)))

    def to_utm(self, e: Column, n: Column, u: Column) -> tuple[Column, Column, Column]:
        lat, lon, alt = self.to_geodetic(e, n, u)
        zone = int((self.lon0 + 180) // 6) + 1
        return (*utm(lat, lon, F.lit(zone), self.lat0 < 0), alt)


def enu_between(lat: Column, lon: Column, alt: Column, lat0: Column, lon0: Column, alt0: Column) -> tuple[Column, Column, Column]:
    """The same with an origin per row."""
    dx, dy, dz = (a - b for a, b in zip(ecef(lat, lon, alt), ecef(lat0, lon0, alt0)))
    sp, cp, sl, cl = F.sin(F.radians(lat0)), F.cos(F.radians(lat0)), F.sin(F.radians(lon0)), F.cos(F.radians(lon0))
    return -sl * dx + cl * dy, -sp * cl * dx - sp * sl * dy + cp * dz, cp * cl * dx + cp * sl * dy + sp * dz


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def utm_epsg(lat: Column, lon: Column) -> Column:
    return F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700)) + utm_zone(lon)


def _series() -> tuple[float, list[float]]:
    """Rectifying radius and the coefficients of the transverse Mercator series in the third flattening, to sixth order."""
    n = FLAT / (2 - FLAT)
    # Krueger's coefficients, row k for the 2k-fold angle, from n**k upwards.
    rows = [
        [1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800],
        [13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360],
        [61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440],
        [49561 / 161280, -179 / 168, 6601661 / 7257600],
        [34729 / 80640, -3418889 / 1995840],
        [212378941 / 319334400],
    ]
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    return radius, [sum(c * n ** (k + i) for i, c in enumerate(row)) for k, row in enumerate(rows, 1)]


def utm(lat: Column, lon: Column, zone: Column, south: bool | Column = False) -> tuple[Column, Column]:
    """Easting and northing of the transverse Mercator projection, Krueger's series to sixth order."""
    radius, alpha = _series()
    e = sqrt(E2)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    atanh = lambda x: 0.5 * F.log((1 + x) / (1 - x))
    t = F.sinh(atanh(F.sin(phi)) - e * atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    north, east = xi, eta
    for k, a in enumerate(alpha, 1):
        north = north + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        east = east + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    shift = F.when(south, 10_000_000.0).otherwise(0.0) if isinstance(south, Column) else F.lit(10_000_000.0 if south else 0.0)
    return 0.9996 * radius * east + 500_000.0, 0.9996 * radius * north + shift


def ground_sampling_distance(alt: Column, sensor: Column, focal: Column, width: Column) -> Column:
    """Metres per pixel; an argument that isn't positive is an error."""
    bad = (alt <= 0) | (sensor <= 0) | (focal <= 0) | (width <= 0)
    return F.when(bad, F.raise_error(F.lit("ground sampling distance needs positive arguments")).cast("double")).otherwise(alt * sensor / (focal * width))


