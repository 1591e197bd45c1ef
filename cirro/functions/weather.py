"""Scalar feature functions (F2, F4, F8-F15) as JVM-side Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cirro.functions.stats import finite_or


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def event_flag(c, thr: float = 0.1) -> Column:
    """value > threshold, NULL reads as false."""
    return F.coalesce(_c(c) > thr, F.lit(False))


def sanitize(c, default=None) -> Column:
    """NaN and +/-inf -> ``default`` (NULL when None); arrays element-wise."""
    d = F.lit(default).cast("double") if default is not None else F.lit(None).cast("double")
    return finite_or(_c(c), d)


def sanitize_array(c, default=None) -> Column:
    d = F.lit(default).cast("double") if default is not None else F.lit(None).cast("double")
    return F.transform(_c(c), lambda x: finite_or(x, d))


def _clean(c: Column, kind: T.DataType, default) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return finite_or(c, F.lit(default).cast(kind)) if default is not None else finite_or(c, F.lit(None).cast(kind))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_clean(c[f.name], f.dataType, default).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _clean(x, kind.elementType, default))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: _clean(v, kind.valueType, default))
    return c


def sanitize_all(df: DataFrame, default=None) -> DataFrame:
    """F4, recursively: NaN and +/-inf -> ``default`` (NULL when None) in every double or float of every column, inside
    structs, arrays and map values of any depth."""
    return df.select(*[_clean(F.col(f"`{f.name}`"), f.dataType, default).alias(f.name) for f in df.schema.fields])


def interactions(t="temperature", h="humidity", p="pressure", w="wind_speed",
                 analytics: bool = False) -> list[tuple[str, Column]]:
    """F8: T*H/100 and P*H/1000 (features); T*P/100 and W*H/100 added for
    the analytics view, whose terms are NaN -> 0."""
    out = [("temp_humidity", _c(t) * _c(h) / 100), ("pressure_humidity", _c(p) * _c(h) / 1000)]
    if analytics:
        out += [("temp_pressure", _c(t) * _c(p) / 100), ("wind_humidity", _c(w) * _c(h) / 100)]
        out = [(n, F.coalesce(e, F.lit(0.0))) for n, e in out]
    return out


def iso_format(ts) -> Column:
    """ISO text like ``datetime.isoformat()`` (fraction only when non-zero)."""
    t = _c(ts)
    frac = F.date_format(t, "SSSSSS")
    return F.when(frac == "000000", F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
        F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def parse_day_first(text) -> Column:
    """The reference's ``dd/mm/yyyy hh:mm`` input format."""
    return F.to_timestamp_ntz(_c(text), F.lit("dd/MM/yyyy HH:mm"))


def horizon_hours(target, now, cap: int | None = 168) -> Column:
    """whole hours from ``now`` to ``target`` truncated toward zero,
    at least 1; capped at ``cap`` (the API's limit) unless None."""
    secs = F.timestamp_diff("SECOND", _c(now), _c(target))
    h = F.when(secs >= 0, F.floor(secs / 3600)).otherwise(-F.floor(-secs / 3600))
    h = F.greatest(F.lit(1), h.cast("long"))
    return F.least(F.lit(cap), h) if cap is not None else h


def thermo_proxies(t="temperature", h="humidity", p="pressure") -> list[tuple[str, Column]]:
    """F11 (first version): equivalent-potential-temperature proxy,
    saturation deficit, lifted-index proxy."""
    return [("theta_e_proxy", _c(t) * F.exp(0.0002 * _c(h) * _c(p) / 1000)),
            ("sat_deficit", _c(h) - 100),
            ("lifted_index_proxy", _c(t) - 10 * F.log(_c(p) / 1000))]


def storm_risk(dp3, h="humidity") -> Column:
    """-clip(dP_3h, -10, 0) * H / 100."""
    return -F.greatest(F.lit(-10.0), F.least(F.lit(0.0), _c(dp3))) * _c(h) / 100


def frontal_indicator(dp3, dt3) -> Column:
    """1.0 when |dP_3h| > 2 and |dT_3h| > 2, else 0.0."""
    return F.when((F.abs(_c(dp3)) > 2) & (F.abs(_c(dt3)) > 2), 1.0).otherwise(0.0)


def calendar_parts(ts="ts") -> list[tuple[str, Column]]:
    """hour, day of year, month."""
    t = _c(ts)
    return [("hour", F.hour(t)), ("day_of_year", F.dayofyear(t)), ("month", F.month(t))]


def cyclic_time(ts="ts", year_days: float = 365.25, compat_week: bool = False) -> list[tuple[str, Column]]:
    """sin/cos of hour/24, day-of-year/``year_days`` and hour of week
    /168.  ``compat_week`` reproduces the reference's formula, which uses
    the hour of the day over 168 (Q11)."""
    t = _c(ts)
    two_pi = 2 * math.pi
    how = F.hour(t) if compat_week else F.weekday(t) * 24 + F.hour(t)
    return [("hour_sin", F.sin(two_pi * F.hour(t) / 24)), ("hour_cos", F.cos(two_pi * F.hour(t) / 24)),
            ("doy_sin", F.sin(two_pi * F.dayofyear(t) / year_days)),
            ("doy_cos", F.cos(two_pi * F.dayofyear(t) / year_days)),
            ("week_sin", F.sin(two_pi * how / 168)), ("week_cos", F.cos(two_pi * how / 168))]
