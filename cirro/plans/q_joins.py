"""Driver queries for joins (J1-J3; J4 ``stack_models`` is in q_metrics).

Points are customers and stations the valid suppliers' stations of
``q_sources.station_list``; customer coordinates are rendered from the
account balance and key (input only).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cirro.operators import joins as J
from cirro.plans import views as V
from cirro.plans.q_sources import STATIONS_SQL_INNER, stations
from cirro.plans.registry import register, rounded


def points(spark, sf_dir):
    c = V.table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("point_id"),
                    ((F.col("c_acctbal") + 1000) % 180 - 90).alias("lat"),
                    ((F.col("c_custkey") * 7.3) % 360 - 180).alias("lon"))


_POINTS_SQL = "(SELECT c_custkey AS point_id, (c_acctbal + 1000) % 180 - 90 AS lat, (c_custkey * 7.3) % 360 - 180 AS lon FROM customer)"


def _knn_sql(metric: str) -> str:
    if metric == "degrees":
        d = "sqrt((p.lat - s.lat) ^ 2 + (p.lon - s.lon) ^ 2)"
    else:
        chord = ("sqrt((cos(radians(p.lat)) * cos(radians(p.lon)) - cos(radians(s.lat)) * cos(radians(s.lon))) ^ 2"
                 " + (cos(radians(p.lat)) * sin(radians(p.lon)) - cos(radians(s.lat)) * sin(radians(s.lon))) ^ 2"
                 " + (sin(radians(p.lat)) - sin(radians(s.lat))) ^ 2)")
        d = f"2 * 6371.0088 * asin(least(1.0, {chord} / 2))"
    return f"""SELECT point_id, station_id, CAST(rank AS INTEGER) AS rank, distance FROM (
  SELECT p.point_id, s.station_id, {d} AS distance,
         row_number() OVER (PARTITION BY p.point_id ORDER BY {d}, s.station_id) AS rank
  FROM {_POINTS_SQL} AS p, ({STATIONS_SQL_INNER}) AS s) AS t WHERE rank <= 5"""


@register("nearest_k", rounded(_knn_sql("degrees"), ["point_id", "station_id", "rank"], ["distance"]))
def q_knn(spark, sf_dir):
    st = stations(spark, sf_dir).select("station_id", "lat", "lon")
    return J.nearest_k(points(spark, sf_dir), st, k=5, metric="degrees")


@register("nearest_k_haversine", rounded(_knn_sql("haversine"), ["point_id", "station_id", "rank"],
                                         ["distance"], {"distance": 4}), digits={"distance": 4})
def q_knn_hav(spark, sf_dir):
    st = stations(spark, sf_dir).select("station_id", "lat", "lon")
    return J.nearest_k(points(spark, sf_dir), st, k=5, metric="haversine")


def _locations_sql():
    from cirro.sources.readers import LOCATIONS
    named = ", ".join(f"('{i}', '{n}', {a}::DOUBLE, {b}::DOUBLE)" for i, n, a, b in LOCATIONS)
    return rounded(f"""SELECT * FROM (VALUES {named}) AS v(location_id, name, lat, lon)
UNION ALL SELECT 'custom', CASE WHEN point_id % 3 = 0 THEN 'Customer ' || point_id ELSE printf('Custom (%.4f, %.4f)', lat::DOUBLE, lon::DOUBLE) END, lat, lon
FROM {_POINTS_SQL} AS p""", ["location_id", "name"], ["lat", "lon"])


@register("location_dim", _locations_sql())
def q_locations(spark, sf_dir):
    """The named locations and every customer's point, a third of them with names."""
    from cirro.sources.readers import location_dim
    p = points(spark, sf_dir)
    return location_dim(spark, p.withColumn("name", F.when(F.col("point_id") % 3 == 0, F.concat(F.lit("Customer "), "point_id"))))


def observations(spark, sf_dir):
    """Per supplier station: its latest report of each kind, rendered from
    all lineitem rows (25 units or more: 'observation', else 'metar'; a
    report of a line without much discount has no reading)."""
    li = V.table(spark, sf_dir, "lineitem").withColumn(
        "kind", F.when(F.col("l_quantity") >= 25, "observation").otherwise("metar")).withColumn(
        "reading", F.when(F.col("l_discount") >= 0.08, F.col("l_tax")))
    st = stations(spark, sf_dir).select("station_id", F.col("s_suppkey").alias("l_suppkey"))
    j = li.join(st, "l_suppkey")
    return j.groupBy("station_id", "kind").agg(
        F.max_by("reading", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("value"))


FIRST_SQL = rounded(f"""
WITH k AS ({_knn_sql('degrees')}),
st AS ({STATIONS_SQL_INNER}),
o AS (SELECT st.station_id, CASE WHEN l_quantity >= 25 THEN 'observation' ELSE 'metar' END AS kind,
        arg_max(struct_pack(v := CASE WHEN l_discount >= 0.08 THEN l_tax END), (l_shipdate, l_orderkey, l_linenumber)).v AS value
      FROM lineitem JOIN st ON lineitem.l_suppkey = st.s_suppkey GROUP BY 1, 2),
c AS (SELECT k.point_id, k.station_id, k.rank, o.kind, o.value,
        row_number() OVER (PARTITION BY k.point_id ORDER BY k.rank, CASE o.kind WHEN 'observation' THEN 0 ELSE 1 END) AS r
      FROM k JOIN o ON k.station_id = o.station_id WHERE o.value IS NOT NULL)
SELECT p.point_id, station_id, rank, kind, value FROM (SELECT DISTINCT point_id FROM k) AS p
  LEFT JOIN (SELECT * FROM c WHERE r = 1) AS b ON b.point_id = p.point_id""",
    ["point_id", "station_id", "rank", "kind"], ["value"])


@register("first_reporting", FIRST_SQL)
def q_first(spark, sf_dir):
    st = stations(spark, sf_dir).select("station_id", "lat", "lon")
    ranked = J.nearest_k(points(spark, sf_dir), st, k=5, metric="degrees")
    return J.first_reporting(ranked, observations(spark, sf_dir), kinds=["observation", "metar"])


ALIGN_SQL = rounded(f"""
SELECT h.series_id, h.ts, h.v_avg, o.amount AS order_amount
FROM {V.EV_HOURLY_SQL} AS h LEFT JOIN (SELECT o_orderdate AS ts, sum(o_totalprice) AS amount FROM orders GROUP BY 1) AS o
ON h.ts = o.ts""", ["series_id", "ts"], ["v_avg", "order_amount"])


@register("index_align", ALIGN_SQL)
def q_align(spark, sf_dir):
    """Daily order totals assigned to the hourly event rows stamped at the
    same instant (midnight rows)."""
    h = V.ev_hourly(spark, sf_dir).select("series_id", "ts", "v_avg")
    o = (V.table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("timestamp_ntz").alias("ts"))
         .agg(F.sum("o_totalprice").alias("order_amount")))
    return J.index_align(h, o, ["ts"])
