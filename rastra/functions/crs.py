"""Coordinate reference systems: definitions, projections and datum shifts, as column expressions or in numpy.

Every formula is written once over a small set of functions (``SPARK`` or ``NUMPY``), so that whole columns are
transformed inside generated code, and single points on the driver in the same way.  ``project`` puts values that
a formula needs more than once into columns of their own; written into each other they would grow without bound.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from types import SimpleNamespace

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

SPARK = SimpleNamespace(sin=F.sin, cos=F.cos, tan=F.tan, atan=F.atan, atan2=F.atan2, asin=F.asin, sinh=F.sinh, asinh=F.asinh, atanh=F.atanh, cosh=F.cosh, log=F.log, exp=F.exp, sqrt=F.sqrt, hypot=F.hypot,
                        least=lambda a, b: F.least(F.lit(b), a), greatest=lambda a, b: F.greatest(F.lit(b), a), keep=lambda x: x)
NUMPY = SimpleNamespace(sin=np.sin, cos=np.cos, tan=np.tan, atan=np.arctan, atan2=np.arctan2, asin=np.arcsin, sinh=np.sinh, asinh=np.arcsinh, atanh=np.arctanh, cosh=np.cosh, log=np.log, exp=np.exp, sqrt=np.sqrt, hypot=np.hypot,
                        least=np.minimum, greatest=np.maximum, keep=lambda x: x)

#: Definitions of the codes that are known by name; UTM zones (326xx, 327xx) follow from their number.
DEFINITIONS = {
    4326: "+proj=longlat +datum=WGS84",
    4258: "+proj=longlat +ellps=GRS80",
    4313: "+proj=longlat +ellps=intl +towgs84=-106.8686,52.2978,-103.7239,0.3366,-0.457,1.8422,-1.2747",
    3857: "+proj=merc +a=6378137 +b=6378137 +lon_0=0 +x_0=0 +y_0=0",
    3395: "+proj=merc +lon_0=0 +x_0=0 +y_0=0 +datum=WGS84",
    31370: "+proj=lcc +lat_1=51.16666723333333 +lat_2=49.8333339 +lat_0=90 +lon_0=4.367486666666666 +x_0=150000.013 +y_0=5400088.438 +ellps=intl +towgs84=-106.8686,52.2978,-103.7239,0.3366,-0.457,1.8422,-1.2747",
    3812: "+proj=lcc +lat_1=49.83333333333334 +lat_2=51.16666666666666 +lat_0=50.797815 +lon_0=4.359215833333333 +x_0=649328 +y_0=665262 +ellps=GRS80",
    3035: "+proj=laea +lat_0=52 +lon_0=10 +x_0=4321000 +y_0=3210000 +ellps=GRS80",
}
#: Semi-major axis and inverse flattening.
ELLIPSOIDS = {"WGS84": (6378137.0, 298.257223563), "GRS80": (6378137.0, 298.257222101), "intl": (6378388.0, 297.0), "bessel": (6377397.155, 299.1528128), "clrk66": (6378206.4, 294.9786982), "airy": (6377563.396, 299.3249646)}
_WKT = re.compile(r"^(GEOGCS|PROJCS|GEOCCS|VERT_CS|LOCAL_CS|COMPD_CS|GEODCRS|GEOGCRS|PROJCRS|VERTCRS|ENGCRS|COMPOUNDCRS|BOUNDCRS)\[", re.I)


@dataclass(frozen=True)
class Crs:
    kind: str
    a: float
    e2: float
    p: dict = field(hash=False)
    shift: tuple[float, ...] | None = None
    epsg: int | None = None

    @property
    def geographic(self) -> bool:
        return self.kind == "longlat"


def proj_string(code: int) -> str:
    if code in DEFINITIONS:
        return DEFINITIONS[code]
    if 32601 <= code <= 32660 or 32701 <= code <= 32760:
        return f"+proj=utm +zone={code % 100} +datum=WGS84" + (" +south" if code >= 32700 else "")
    raise ValueError(f"no definition of EPSG:{code}")


def epsg_of(text: str) -> int | None:
    """The code that a definition names: EPSG:n, or the authority of the outermost node of a WKT."""
    text = text.strip()
    if m := re.fullmatch(r"EPSG:(\d+)", text, re.I):
        return int(m[1])
    if text.upper() == "WGS84":
        return 4326
    if _WKT.match(text):
        found = re.findall(r'(?:AUTHORITY|ID)\["EPSG",\s*"?(\d+)"?\]\s*\]$', re.sub(r"\s+", "", text), re.I)
        return int(found[-1]) if found else None
    return None


def parse(text: str | int) -> Crs:
    """A system from EPSG:n, n, WGS84, a PROJ string, or a WKT with an authority code."""
    code = text if isinstance(text, int) else epsg_of(text)
    if code is None and not text.strip().startswith("+"):
        raise ValueError(f"not a coordinate reference system: {text!r}")
    found = dict(re.findall(r"\+(\w+)(?:=(\S+))?", proj_string(code) if code is not None else text))
    if "a" in found:
        a = float(found["a"])
        flat = 1 / float(found["rf"]) if "rf" in found else 1 - float(found.get("b", a)) / a
    else:
        a, inverse = ELLIPSOIDS[found.get("ellps") or found.get("datum") or "WGS84"]
        flat = 1 / inverse
    kind = found.get("proj", "")
    p = {k: float(found[k]) for k in ("lat_0", "lat_1", "lat_2", "lon_0", "lat_ts", "x_0", "y_0", "k", "k_0") if found.get(k)}
    if kind == "utm":
        kind, zone = "tmerc", int(found["zone"])
        p = {"lon_0": zone * 6 - 183.0, "k": 0.9996, "x_0": 500000.0, "y_0": 1e7 if "south" in found else 0.0}
    if kind in ("latlong", "latlon"):
        kind = "longlat"
    if kind not in ("longlat", "merc", "tmerc", "lcc", "laea"):
        raise ValueError(f"projection {kind!r} is not known")
    shift = tuple(float(x) for x in found["towgs84"].split(",")) if found.get("towgs84") else None
    return Crs(kind, a, flat * (2 - flat), p, shift if shift and any(shift) else None, code)


def _t(m, lat, e):
    """tan of half the conformal colatitude."""
    s = e * m.sin(lat)
    return m.tan(math.pi / 4 - lat / 2) * m.exp(m.atanh(s) * e) if e else m.tan(math.pi / 4 - lat / 2)


def _from_conformal(m, chi, e2):
    """Latitude of a conformal latitude, by series in the eccentricity."""
    e4, e6, e8 = e2**2, e2**3, e2**4
    chi = m.keep(chi)
    return (chi + m.sin(2 * chi) * (e2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360) + m.sin(4 * chi) * (7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520)
            + m.sin(6 * chi) * (7 * e6 / 120 + 81 * e8 / 1120) + m.sin(8 * chi) * (4279 * e8 / 161280))


def _q(m, s, e):
    return (1 - e * e) * (s / (1 - e * e * s * s) + m.atanh(e * s) / e) if e else 2 * s


def _lcc(c: Crs):
    e = math.sqrt(c.e2)
    rad = lambda k, d=0.0: math.radians(c.p.get(k, d))
    one, two, zero = rad("lat_1"), rad("lat_2", c.p.get("lat_1", 0.0)), rad("lat_0")
    width = lambda lat: math.cos(lat) / math.sqrt(1 - c.e2 * math.sin(lat) ** 2)
    half = lambda lat: float(_t(NUMPY, lat, e)) if lat < math.pi / 2 - 1e-12 else 0.0
    n = math.sin(one) if abs(one - two) < 1e-12 else math.log(width(one) / width(two)) / math.log(half(one) / half(two))
    scale = c.a * width(one) / (n * half(one) ** n) * c.p.get("k_0", c.p.get("k", 1.0))
    return n, scale, scale * half(zero) ** n, e


def _krueger(c: Crs):
    f = 1 - math.sqrt(1 - c.e2)
    n = f / (2 - f)
    radius = c.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    out = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    back = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    return radius, out, back


def _tm_north(m, c: Crs, lat):
    """Rectified northing along the central meridian, over the radius."""
    _, out, _ = _krueger(c)
    e = math.sqrt(c.e2)
    chi = m.atan(m.sinh(m.asinh(m.tan(lat)) - e * m.atanh(e * m.sin(lat))))
    return chi + sum(a * m.sin(2 * (k + 1) * chi) for k, a in enumerate(out))


def forward(m, c: Crs, lon, lat):
    """x, y of longitude and latitude in degrees."""
    if c.geographic:
        return lon, lat
    rad, e = math.pi / 180, math.sqrt(c.e2)
    x0, y0 = c.p.get("x_0", 0.0), c.p.get("y_0", 0.0)
    lam, phi = m.keep((lon - c.p.get("lon_0", 0.0)) * rad), m.keep(lat * rad)
    if c.kind == "merc":
        phi = m.least(m.greatest(phi, -1.4844222297453324), 1.4844222297453324)  # where Web Mercator's square ends
        ts = math.radians(c.p.get("lat_ts", 0.0))
        k = c.p.get("k_0", c.p.get("k", math.cos(ts) / math.sqrt(1 - c.e2 * math.sin(ts) ** 2)))
        return lam * (c.a * k) + x0, m.log(_t(m, phi, e)) * (-c.a * k) + y0
    if c.kind == "lcc":
        n, scale, r0, e = _lcc(c)
        r = m.keep(m.exp(m.log(_t(m, phi, e)) * n) * scale)
        return r * m.sin(lam * n) + x0, r * m.cos(lam * n) * -1 + (r0 + y0)
    if c.kind == "tmerc":
        radius, out, _ = _krueger(c)
        t = m.keep(m.sinh(m.asinh(m.tan(phi)) - e * m.atanh(e * m.sin(phi))))
        xi, eta = m.keep(m.atan2(t, m.cos(lam))), m.keep(m.asinh(m.sin(lam) / m.hypot(t, m.cos(lam))))
        north = xi + sum(a * m.sin(2 * (k + 1) * xi) * m.cosh(2 * (k + 1) * eta) for k, a in enumerate(out))
        east = eta + sum(a * m.cos(2 * (k + 1) * xi) * m.sinh(2 * (k + 1) * eta) for k, a in enumerate(out))
        k0 = c.p.get("k", c.p.get("k_0", 1.0))
        start = float(_tm_north(NUMPY, c, math.radians(c.p.get("lat_0", 0.0))))
        return east * (k0 * radius) + x0, (north - start) * (k0 * radius) + y0
    beta, centre, rq, d = _laea(m, c, phi)
    beta = m.keep(beta)
    b = m.keep(m.sqrt(2 / (1 + math.sin(centre) * m.sin(beta) + math.cos(centre) * m.cos(beta) * m.cos(lam))) * rq)
    x = b * d * m.cos(beta) * m.sin(lam)
    return x + x0, b / d * (math.cos(centre) * m.sin(beta) - math.sin(centre) * m.cos(beta) * m.cos(lam)) + y0


def _laea(m, c: Crs, phi=None):
    e = math.sqrt(c.e2)
    zero = math.radians(c.p.get("lat_0", 0.0))
    qp = float(_q(NUMPY, 1.0, e))
    rq, centre = c.a * math.sqrt(qp / 2), math.asin(float(_q(NUMPY, math.sin(zero), e)) / qp)
    d = c.a * math.cos(zero) / (math.sqrt(1 - c.e2 * math.sin(zero) ** 2) * rq * math.cos(centre))
    return (m.asin(_q(m, m.sin(phi), e) / qp) if phi is not None else None), centre, rq, d


def inverse(m, c: Crs, x, y):
    """Longitude and latitude in degrees of x, y."""
    if c.geographic:
        return x, y
    deg = 180 / math.pi
    x, y, lon0 = m.keep(x - c.p.get("x_0", 0.0)), m.keep(y - c.p.get("y_0", 0.0)), c.p.get("lon_0", 0.0)
    if c.kind == "merc":
        ts = math.radians(c.p.get("lat_ts", 0.0))
        k = c.p.get("k_0", c.p.get("k", math.cos(ts) / math.sqrt(1 - c.e2 * math.sin(ts) ** 2)))
        chi = math.pi / 2 - 2 * m.atan(m.exp(y / (-c.a * k)))
        return x / (c.a * k) * deg + lon0, _from_conformal(m, chi, c.e2) * deg
    if c.kind == "lcc":
        n, scale, r0, _ = _lcc(c)
        sign = 1 if n > 0 else -1
        up = r0 - y
        t = m.exp(m.log(m.hypot(x, up) / abs(scale)) / n)
        return m.atan2(x * sign, up * sign) / n * deg + lon0, _from_conformal(m, math.pi / 2 - 2 * m.atan(t), c.e2) * deg
    if c.kind == "tmerc":
        radius, _, back = _krueger(c)
        k0 = c.p.get("k", c.p.get("k_0", 1.0))
        start = float(_tm_north(NUMPY, c, math.radians(c.p.get("lat_0", 0.0))))
        xi, eta = m.keep(y / (k0 * radius) + start), m.keep(x / (k0 * radius))
        north = xi - sum(b * m.sin(2 * (k + 1) * xi) * m.cosh(2 * (k + 1) * eta) for k, b in enumerate(back))
        east = eta - sum(b * m.cos(2 * (k + 1) * xi) * m.sinh(2 * (k + 1) * eta) for k, b in enumerate(back))
        north, east = m.keep(north), m.keep(east)
        chi = m.asin(m.sin(north) / m.cosh(east))
        return m.atan2(m.sinh(east), m.cos(north)) * deg + lon0, _from_conformal(m, chi, c.e2) * deg
    _, centre, rq, d = _laea(m, c)
    rho = m.keep(m.hypot(x / d, y * d))
    ce = m.keep(2 * m.asin(rho / (2 * rq)))
    over = m.greatest(rho, 1e-12)
    beta = m.keep(m.asin(m.cos(ce) * math.sin(centre) + y * d * m.sin(ce) * math.cos(centre) / over))
    lam = m.atan2(x / d * m.sin(ce), over * math.cos(centre) * m.cos(ce) - y * d * math.sin(centre) * m.sin(ce))
    e2, e4, e6 = c.e2, c.e2**2, c.e2**3
    phi = beta + m.sin(2 * beta) * (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) + m.sin(4 * beta) * (23 * e4 / 360 + 251 * e6 / 3780) + m.sin(6 * beta) * (761 * e6 / 45360)
    return lam * deg + lon0, phi * deg


def _geocentric(m, c: Crs, lon, lat):
    rad = math.pi / 180
    lon, lat = m.keep(lon), m.keep(lat)
    s = m.keep(m.sin(lat * rad))
    n = m.keep(c.a / m.sqrt(1 - c.e2 * s * s))
    return n * m.cos(lat * rad) * m.cos(lon * rad), n * m.cos(lat * rad) * m.sin(lon * rad), n * (1 - c.e2) * s


def _geodetic(m, c: Crs, x, y, z):
    b = c.a * math.sqrt(1 - c.e2)
    x, y, z = m.keep(x), m.keep(y), m.keep(z)
    p = m.keep(m.hypot(x, y))
    u = m.keep(m.atan2(z * c.a, p * b))
    lat = m.atan2(z + (c.a**2 - b**2) / b * m.sin(u) * m.sin(u) * m.sin(u), p - c.e2 * c.a * m.cos(u) * m.cos(u) * m.cos(u))
    return m.atan2(y, x) * (180 / math.pi), lat * (180 / math.pi)


def _shift(c: Crs, x, y, z, back: bool):
    dx, dy, dz, *more = c.shift
    rx, ry, rz = (v * math.pi / 648000 for v in (more[:3] if len(more) >= 3 else (0, 0, 0)))
    scale = 1 + (more[3] * 1e-6 if len(more) > 3 else 0.0)
    if back:
        x, y, z = (x - dx) / scale, (y - dy) / scale, (z - dz) / scale
        return x + rz * y - ry * z, y - rz * x + rx * z, z + ry * x - rx * y
    return (x - rz * y + ry * z) * scale + dx, (rz * x + y - rx * z) * scale + dy, (z - ry * x + rx * y) * scale + dz


WGS84 = Crs("longlat", 6378137.0, (2 - 1 / 298.257223563) / 298.257223563, {}, None, 4326)


def transform(x, y, source: str | int | Crs, target: str | int | Crs, m=None):
    """A point (longitude or easting first) of one system in another: two columns, or numbers and arrays."""
    source, target = (c if isinstance(c, Crs) else parse(c) for c in (source, target))
    m = m or (SPARK if isinstance(x, Column) else NUMPY)
    lon, lat = (m.keep(v) for v in inverse(m, source, x, y))
    if source.shift != target.shift:
        x, y, z = _geocentric(m, source, lon, lat)
        x, y, z = m.keep(x), m.keep(y), m.keep(z)
        if source.shift:
            x, y, z = (m.keep(v) for v in _shift(source, x, y, z, False))
        if target.shift:
            x, y, z = _shift(target, x, y, z, True)
        lon, lat = _geodetic(m, target, x, y, z)
    return forward(m, target, lon, lat)


class _Staged:
    """``SPARK`` over the columns of a frame, with ``keep`` adding one."""

    def __init__(self, df: DataFrame):
        self.df, self.names = df, []

    def __getattr__(self, name: str):
        return getattr(SPARK, name)

    def keep(self, value):
        if not isinstance(value, Column):
            return value
        self.names.append(f"__stage{len(self.names)}")
        self.df = self.df.withColumn(self.names[-1], value)
        return F.col(self.names[-1])


def project(df: DataFrame, x: Column, y: Column, source, target, to: tuple[str, str] = ("x", "y")) -> DataFrame:
    """``df`` with a point of one system in another in the columns ``to``: as ``transform``, stage by stage."""
    m = _Staged(df)
    a, b = transform(m.keep(x), m.keep(y), source, target, m)
    return m.df.withColumns({to[0]: a, to[1]: b}).drop(*m.names)
