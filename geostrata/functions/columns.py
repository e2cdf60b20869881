"""Column expressions shared by the operators. Everything here stays inside code generation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EARTH_RADIUS_KM = 6371.0088


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Round and turn a negative zero into zero, so equal values compare equal as text."""
    return F.round(col(c).cast("double"), digits) + F.lit(0.0)


def clipped(c: Column | str, lower: float | None = None, upper: float | None = None) -> Column:
    """Limit to the bounds; a null stays null (``least``/``greatest`` alone would skip it)."""
    value = col(c)
    out = value
    if lower is not None:
        out = F.greatest(out, F.lit(lower))
    if upper is not None:
        out = F.least(out, F.lit(upper))
    return F.when(value.isNotNull(), out)


def as_number(c: Column | str) -> Column:
    """Coerce to double; text that is not a number, and NaN, become null."""
    value = col(c).try_cast("double")
    return F.when(~F.isnan(value), value)


def flag(condition: Column) -> Column:
    """1 when the condition holds, 0 when it does not or is unknown."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def count_where(condition: Column) -> Column:
    return F.coalesce(F.sum(flag(condition)), F.lit(0)).cast("long")


def share_where(condition: Column) -> Column:
    return F.avg(flag(condition).cast("double"))


def ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation; null for a constant side (the built-in fails on it in ANSI mode)."""
    a, b = col(x), col(y)
    return ratio(F.covar_pop(a, b), F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b)))


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating NaN marks a missing value in many sources; Spark only treats NULL as missing."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not floats:
        return df
    return df.withColumns({c: F.when(~F.isnan(F.col(c)), F.col(c)) for c in floats})


# --- distances ---------------------------------------------------------------------------------


def haversine_km(lat1, lng1, lat2, lng2) -> Column:
    """Great-circle distance in km."""
    a1, a2 = F.radians(col(lat1)), F.radians(col(lat2))
    half_lat = F.sin((a2 - a1) / 2)
    half_lng = F.sin((F.radians(col(lng2)) - F.radians(col(lng1))) / 2)
    inner = half_lat * half_lat + F.cos(a1) * F.cos(a2) * half_lng * half_lng
    return F.asin(F.sqrt(F.least(F.lit(1.0), inner))) * (2 * EARTH_RADIUS_KM)


def sphere_xyz(lat, lng, radius: float = EARTH_RADIUS_KM) -> list[Column]:
    """Point on a sphere as three Cartesian columns."""
    la, ln = F.radians(col(lat)), F.radians(col(lng))
    return [F.cos(la) * F.cos(ln) * radius, F.cos(la) * F.sin(ln) * radius, F.sin(la) * radius]


def chord_km(arc_km: float) -> float:
    """Straight-line length below a great-circle arc."""
    return 2 * EARTH_RADIUS_KM * math.sin(min(arc_km / (2 * EARTH_RADIUS_KM), math.pi / 2))


def in_ring(d: Column, a: float, b: float, closed: str = "left") -> Column:
    """Ring membership: ``[a, b)`` or ``(a, b]``; the innermost right-closed ring keeps 0."""
    if closed == "left":
        return (d >= a) & (d < b)
    return (d <= b) if a <= 0 else (d > a) & (d <= b)


def ring_weight(d: Column | str, rings: Sequence[tuple[float, float, float]], closed: str = "left") -> Column:
    """Weight of the ring that holds ``d``; 0 beyond the last ring."""
    d = col(d)
    out = F.lit(0.0)
    for a, b, w in reversed(list(rings)):
        out = F.when(in_ring(d, a, b, closed), F.lit(float(w))).otherwise(out)
    return out


# --- grids -------------------------------------------------------------------------------------

# A hexagon's axial pair (q, r) is packed into one bigint so that a neighbour is an addition.
_SPAN = 1 << 23
_HALF = 1 << 22
HEX_EDGE_KM = {7: 1.406476, 8: 0.531414, 9: 0.200786}
KM_PER_RADIAN = EARTH_RADIUS_KM


def square_cell(lat, lng, size: float = 0.01) -> Column:
    """``floor(lat/size)_floor(lng/size)``; null when a coordinate is null."""
    la, ln = col(lat), col(lng)
    text = F.concat_ws(
        "_", F.floor(la / size).cast("string"), F.floor(ln / size).cast("string")
    )
    return F.when(la.isNotNull() & ln.isNotNull(), text)


def hex_axial(lat, lng, edge_km: float, lat0: float) -> tuple[Column, Column]:
    """Axial (q, r) of the pointy-top hexagon that holds a point on an equirectangular plane."""
    x = F.radians(col(lng)) * (KM_PER_RADIAN * math.cos(math.radians(lat0)))
    y = F.radians(col(lat)) * KM_PER_RADIAN
    q = (x * (math.sqrt(3) / 3) - y * (1 / 3)) / edge_km
    r = y * (2 / 3) / edge_km
    s = -q - r
    rq, rr, rs = F.rint(q), F.rint(r), F.rint(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    q_out = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    r_out = F.when((dq > dr) & (dq > ds), rr).otherwise(F.when(dr > ds, -rq - rs).otherwise(rr))
    return q_out.cast("long"), r_out.cast("long")


def hex_cell(lat, lng, resolution: int = 8, lat0: float = 37.0) -> Column:
    """Hexagon id as bigint; null when a coordinate is null."""
    q, r = hex_axial(lat, lng, HEX_EDGE_KM[resolution], lat0)
    return F.when(
        col(lat).isNotNull() & col(lng).isNotNull(), (q + _HALF) * _SPAN + (r + _HALF)
    )


def hex_center(cell, resolution: int = 8, lat0: float = 37.0) -> tuple[Column, Column]:
    """(lat, lng) of a hexagon's centre."""
    edge = HEX_EDGE_KM[resolution]
    c = col(cell)
    r = c % _SPAN - _HALF
    q = F.floor(c / F.lit(_SPAN)) - _HALF
    x = (q.cast("double") + r.cast("double") / 2) * (math.sqrt(3) * edge)
    y = r.cast("double") * (1.5 * edge)
    return (
        F.degrees(y / KM_PER_RADIAN),
        F.degrees(x / (KM_PER_RADIAN * math.cos(math.radians(lat0)))),
    )


def hex_offsets(k: int, include_center: bool = True) -> list[int]:
    """Id differences to every hexagon within ``k`` steps."""
    out = []
    for dq in range(-k, k + 1):
        for dr in range(max(-k, -dq - k), min(k, -dq + k) + 1):
            if include_center or (dq, dr) != (0, 0):
                out.append(dq * _SPAN + dr)
    return out


def hex_ring_cells(cell, k: int, include_center: bool = True) -> Column:
    """Array of the cells within ``k`` steps."""
    c = col(cell)
    steps = F.array(*[F.lit(o).cast("long") for o in hex_offsets(k, include_center)])
    return F.transform(steps, lambda o: c + o)
