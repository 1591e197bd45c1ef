"""Driver queries for the spectrum family (W24, W25, T2) and Hurst."""

from __future__ import annotations

from cirro.operators import spectrum as SP
from cirro.plans import views as V
from cirro.plans.registry import register, rounded

N, STEP = 168, 24
WR = "PARTITION BY series_id ORDER BY ts, event_id"

_AMP = f"""WITH r AS (SELECT series_id, x, row_number() OVER ({WR}) - 1 AS j, count(*) OVER (PARTITION BY series_id) AS len
             FROM {V.EV_RAW_SQL} AS q),
wins AS (SELECT series_id, unnest(range(0, CAST(floor((len - 1 - {N}) / {STEP}) AS BIGINT) + 1)) AS win
         FROM (SELECT DISTINCT series_id, len FROM r) AS t WHERE len - 1 - {N} >= 0),
m AS (SELECT w.series_id, w.win, r.j - w.win * {STEP} AS t, r.x FROM wins AS w JOIN r
      ON r.series_id = w.series_id AND r.j >= w.win * {STEP} AND r.j < w.win * {STEP} + {N}),
dm AS (SELECT series_id, win, t, x - avg(x) OVER (PARTITION BY series_id, win) AS v FROM m),
kk AS (SELECT unnest(range(0, {N // 2})) AS k),
f AS (SELECT series_id, win, k, sqrt(pow(sum(v * cos(2 * pi() / {N} * k * t)), 2) + pow(sum(v * sin(2 * pi() / {N} * k * t)), 2)) AS amp
      FROM dm, kk GROUP BY series_id, win, k)"""

SPECTRUM_SQL = rounded(f"""{_AMP}
SELECT series_id, win, win * {STEP} + {N + 1} AS anchor_pos,
  arg_max(k, (amp, -k)) FILTER (WHERE k > 0) / {float(N)} AS dominant_freq, sum(amp * amp) AS spectral_energy
FROM f GROUP BY series_id, win""", ["series_id", "win", "anchor_pos"], ["dominant_freq", "spectral_energy"],
    {"spectral_energy": 1})


@register("window_spectrum", SPECTRUM_SQL, digits={"spectral_energy": 1})
def q_spectrum(spark, sf_dir):
    """Windows of 168 rows every 24th row through numpy's FFT (Pandas UDF)."""
    raw = V.ev_raw(spark, sf_dir)
    return SP.window_spectrum(raw, V.RAW_SPEC, "x", N, STEP).drop("amplitude")


TOPF_SQL = rounded(f"""{_AMP}
SELECT series_id, win, win * {STEP} + {N + 1} AS anchor_pos, CAST(rank AS INTEGER) AS rank, k / {float(N)} AS freq, amp AS amplitude
FROM (SELECT *, row_number() OVER (PARTITION BY series_id, win ORDER BY amp DESC, k) AS rank FROM f) AS z WHERE rank <= 5""",
    ["series_id", "win", "anchor_pos", "rank"], ["freq", "amplitude"], {"amplitude": 3})


@register("top_frequencies", TOPF_SQL, digits={"amplitude": 3})
def q_topf(spark, sf_dir):
    raw = V.ev_raw(spark, sf_dir)
    sp = SP.window_spectrum(raw, V.RAW_SPEC, "x", N, STEP)
    return SP.top_frequencies(sp, ["series_id"], N, 5)


_FEATS = [f"x_dom_freq_{i}" for i in range(1, 6)] + ["x_spectral_energy"]
SPECFEAT_SQL = rounded(f"""{_AMP},
top AS (SELECT series_id, win, k, row_number() OVER (PARTITION BY series_id, win ORDER BY amp DESC, k) AS rk FROM f),
wf AS (SELECT t.series_id, t.win, {", ".join(f"max(k) FILTER (WHERE rk = {i}) / {float(N)} AS x_dom_freq_{i}" for i in range(1, 6))}
       FROM top AS t GROUP BY t.series_id, t.win),
we AS (SELECT series_id, win, sum(amp * amp) AS x_spectral_energy FROM f GROUP BY 1, 2),
rows AS (SELECT series_id, ts, event_id, row_number() OVER ({WR}) AS pos, count(*) OVER (PARTITION BY series_id) AS len
         FROM {V.EV_RAW_SQL} AS q),
rw AS (SELECT *, CAST(least(CASE WHEN pos >= {N + 1} THEN floor((pos - {N + 1}) / {STEP}) ELSE 0 END,
                            floor((len - 1 - {N}) / {STEP})) AS BIGINT) AS win FROM rows)
SELECT rw.series_id, rw.ts, rw.event_id, {", ".join(f"wf.x_dom_freq_{i}" for i in range(1, 6))}, we.x_spectral_energy
FROM rw LEFT JOIN wf ON rw.series_id = wf.series_id AND rw.win = wf.win
LEFT JOIN we ON rw.series_id = we.series_id AND rw.win = we.win""", ["series_id", "ts", "event_id"], _FEATS,
    {"x_spectral_energy": 1})


@register("spectral_features", SPECFEAT_SQL, digits={"x_spectral_energy": 1})
def q_specfeat(spark, sf_dir):
    raw = V.ev_raw(spark, sf_dir).select("series_id", "ts", "event_id", "x")
    return SP.spectral_features(raw, V.RAW_SPEC, "x", N, STEP).drop("x")


HURST_SQL = rounded(f"""
WITH r AS (SELECT series_id, x, row_number() OVER ({WR}) AS pos, count(*) OVER (PARTITION BY series_id) AS len FROM {V.EV_RAW_SQL} AS q),
t AS (SELECT series_id, x, pos - greatest(len - 168, 0) - 1 AS r0, least(len, 168) AS m FROM r WHERE pos > len - 168),
s AS (SELECT *, unnest([8, 16, 32, 64]) AS size FROM t),
c AS (SELECT *, floor(r0 / size) AS chunk FROM s WHERE (floor(r0 / size) + 1) * size <= m),
d AS (SELECT *, x - avg(x) OVER (PARTITION BY series_id, size, chunk) AS dev FROM c),
y AS (SELECT *, sum(dev) OVER (PARTITION BY series_id, size, chunk ORDER BY r0 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS yy FROM d),
ch AS (SELECT series_id, size, chunk, max(yy) - min(yy) AS rr, stddev_pop(x) AS ss FROM y GROUP BY 1, 2, 3),
per AS (SELECT series_id, size, avg(rr / ss) AS rs FROM ch WHERE ss > 0 GROUP BY 1, 2),
h AS (SELECT series_id, regr_slope(ln(rs), ln(size)) AS hurst, count(*) AS n_sizes FROM per GROUP BY 1)
SELECT series_id, hurst, n_sizes, CASE WHEN hurst < 0.5 THEN 'mean-reverting' WHEN hurst > 0.5 THEN 'persistent' ELSE 'random walk' END AS reading
FROM h""", ["series_id", "n_sizes", "reading"], ["hurst"])


@register("hurst_rs", HURST_SQL)
def q_hurst(spark, sf_dir):
    return SP.hurst_rs(V.ev_raw(spark, sf_dir), V.RAW_SPEC, "x", 168)
