"""Joins (J1-J4).

* ``nearest_k``        k closest stations per point, exact, without a
  cross join (``operators.neighbours``).  Metric ``degrees`` (the reference:
  Euclidean in raw degrees) works on lat/lon; ``haversine`` on unit vectors in
  three dimensions (chord length orders the same as great-circle distance).
* ``first_reporting``  walk each point's ranked stations; the first with
  an observation wins, observation kinds tried in order.
* ``index_align``      equi-join on (series, time).
* ``stack_models``     long (key, model, p) -> one column per model.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirro.operators.neighbours import nearest

EARTH_KM = 6371.0088


def _unit(lat, lon):
    la, lo = F.radians(lat), F.radians(lon)
    return F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)


def _coords(df: DataFrame, idc: str, lat: str, lon: str, metric: str, tag: str):
    if metric == "degrees":
        coords = [F.col(lat).cast("double"), F.col(lon).cast("double")]
    else:
        coords = list(_unit(F.col(lat).cast("double"), F.col(lon).cast("double")))
    d = df.select(F.col(idc).alias(f"{tag}id"), *[c.alias(f"{tag}{i}") for i, c in enumerate(coords)])
    return d.filter(F.col(f"{tag}0").isNotNull() & F.col(f"{tag}1").isNotNull()), len(coords)


def nearest_k(points: DataFrame, stations: DataFrame, k: int = 5, metric: str = "haversine",
              point_id: str = "point_id", station_id: str = "station_id",
              lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Exact k nearest stations per point: (point_id, station_id, rank,
    distance), distance in degrees or kilometres; ties broken by station id."""
    if metric not in ("degrees", "haversine"):
        raise ValueError(metric)
    P, dim = _coords(points, point_id, lat, lon, metric, "p")
    S, _ = _coords(stations, station_id, lat, lon, metric, "s")
    res = nearest(P, S, dim, k)
    dist = F.col("_d") if metric == "degrees" else 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.col("_d") / 2))
    return res.select(F.col("pid").alias(point_id), F.col("sid").alias(station_id),
                      F.col("rank").cast("int").alias("rank"), dist.alias("distance"))


def knn_euclidean(points: DataFrame, refs: DataFrame, point_id: str, ref_id: str, dims, k: int,
                  exclude_self: bool = False, group: str | None = None) -> DataFrame:
    """Exact k nearest ``refs`` per point in Euclidean space over ``dims``
    (a few coordinates); with ``group`` only references of the point's
    group count.  Returns (point_id, ref_id, rank, distance)."""
    def side(df, idc, tag):
        return df.select(F.col(idc).alias(f"{tag}id"), *([F.col(group).alias(f"{tag}g")] if group else []),
                         *[F.col(c).cast("double").alias(f"{tag}{i}") for i, c in enumerate(dims)])
    res = nearest(side(points, point_id, "p"), side(refs, ref_id, "s"), len(dims), k, exclude_self)
    return res.select(F.col("pid").alias(point_id), F.col("sid").alias(ref_id),
                      F.col("rank").cast("int").alias("rank"), F.col("_d").alias("distance"))


def first_reporting(ranked: DataFrame, observations: DataFrame, point_id: str = "point_id",
                    station_id: str = "station_id", kind: str = "kind", kinds: Sequence[str] = (),
                    value: str = "value") -> DataFrame:
    """Per point, the observation of the best-ranked station that has
    one; among a station's observation kinds the earlier in ``kinds`` wins.
    Points none of whose stations has one come back with NULLs."""
    order = F.create_map(*[x for i, kd in enumerate(kinds) for x in (F.lit(kd), F.lit(i))])
    obs = observations.filter(F.col(value).isNotNull()).withColumn("_ko", order[F.col(kind)])
    j = ranked.join(obs, station_id, "left")
    best = j.groupBy(point_id).agg(F.min_by(F.struct(F.col(station_id), F.col("rank"), F.col(kind), F.col(value)),
                                            F.when(F.col(value).isNotNull(), F.struct("rank", "_ko"))).alias("_b"))
    return best.select(point_id, F.col(f"_b.{station_id}").alias(station_id), F.col("_b.rank").alias("rank"),
                       F.col(f"_b.{kind}").alias(kind), F.col(f"_b.{value}").alias(value))


def index_align(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Columns of ``right`` assigned to ``left`` by equal index."""
    return left.join(right, list(keys), how)


def stack_models(long: DataFrame, keys: Sequence[str], models: Sequence[str],
                 model: str = "model", p: str = "p") -> DataFrame:
    """One probability column per model (pivot with a fixed model list,
    so Spark needs no extra pass to discover the values)."""
    return long.groupBy(*keys).pivot(model, list(models)).agg(F.first(p))
