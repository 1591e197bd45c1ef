"""Statistics of long trailing frames at a cost that does not grow with the frame.

Spark works out each sliding frame anew, row by row.  Here the rows of a block
are cut into segments of ``w`` rows.  A frame of ``w`` rows that ends inside a
segment is the end of the segment before and the beginning of this one, so
its statistics are those of a *suffix* and a *prefix* put together, and both
are running quantities:

* minimum and maximum: running extremes from both ends of each segment;
* mean, standard deviation, skewness, kurtosis, correlation: counts, means and
  central (co-)moments, updated row by row from both ends and merged.  Nothing
  is a difference of large sums, so values around 1e9 lose no digits.

Rows are dealt by (series, block) with a halo of ``w - 1`` rows, as for all window
operators, and sorted by Spark; a task takes whole blocks, a bounded
buffer at a time, and walks through all segments of all series side by
side (numpy).  Series of similar length are taken together, so that short ones
cost no padding.

NULL and NaN are missing values.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cirro.plans.layout import blocked, with_positions
from cirro.plans.series import BLK, CORE, POS, SeriesSpec

BLOCK_ROWS = 1 << 17
BUFFER_ROWS = 1 << 17


@dataclass(frozen=True)
class Frame:
    """``stat`` (mean, std, min, max, sum, skew, kurt, corr) of ``col`` over ``n`` rows as column
    ``name``; NULL unless ``least`` values (for corr: pairs with ``other``) are there."""
    name: str
    stat: str
    col: str
    n: int
    least: int = 1
    other: str | None = None


@dataclass
class Moments:
    """Count, mean and sums of powers of the distance to the mean."""
    n: np.ndarray
    mean: np.ndarray
    m2: np.ndarray
    m3: np.ndarray | None = None
    m4: np.ndarray | None = None

    @staticmethod
    def none(shape, high: bool) -> "Moments":
        return Moments(*(np.zeros(shape) for _ in range(5 if high else 3)))

    def arrays(self) -> list[np.ndarray]:
        return [x for x in (self.n, self.mean, self.m2, self.m3, self.m4) if x is not None]

    def plus(self, x: np.ndarray) -> "Moments":
        """With one more value each (NaN: none)."""
        here = ~np.isnan(x)
        n1 = self.n
        n = n1 + here
        d = np.where(here, x - self.mean, 0.0)
        dn = d / np.maximum(n, 1.0)
        t = d * dn * n1
        m3 = m4 = None
        if self.m3 is not None:
            dn2 = dn * dn
            m4 = self.m4 + t * dn2 * (n * n - 3 * n + 3) + 6 * dn2 * self.m2 - 4 * dn * self.m3
            m3 = self.m3 + t * dn * (n - 2) - 3 * dn * self.m2
        return Moments(n, self.mean + dn, self.m2 + t, m3, m4)

    def merged(self, b: "Moments") -> "Moments":
        n = self.n + b.n
        safe = np.maximum(n, 1.0)
        d = np.where((self.n > 0) & (b.n > 0), b.mean - self.mean, 0.0)
        mean = np.where(self.n > 0, self.mean, b.mean) + d * b.n / safe
        ab = self.n * b.n
        m2 = self.m2 + b.m2 + d * d * ab / safe
        if self.m3 is None:
            return Moments(n, mean, m2)
        m3 = self.m3 + b.m3 + d ** 3 * ab * (self.n - b.n) / safe ** 2 + 3 * d * (self.n * b.m2 - b.n * self.m2) / safe
        m4 = (self.m4 + b.m4 + d ** 4 * ab * (self.n ** 2 - ab + b.n ** 2) / safe ** 3
              + 6 * d * d * (self.n ** 2 * b.m2 + b.n ** 2 * self.m2) / safe ** 2 + 4 * d * (self.n * b.m3 - b.n * self.m3) / safe)
        return Moments(n, mean, m2, m3, m4)


@dataclass
class CoMoments:
    """Count, means, sums of squares and of products of the pairs that are whole."""
    n: np.ndarray
    mx: np.ndarray
    my: np.ndarray
    xx: np.ndarray
    yy: np.ndarray
    xy: np.ndarray

    @staticmethod
    def none(shape) -> "CoMoments":
        return CoMoments(*(np.zeros(shape) for _ in range(6)))

    def arrays(self) -> list[np.ndarray]:
        return [self.n, self.mx, self.my, self.xx, self.yy, self.xy]

    def plus(self, x: np.ndarray, y: np.ndarray) -> "CoMoments":
        here = ~(np.isnan(x) | np.isnan(y))
        n = self.n + here
        dx, dy = np.where(here, x - self.mx, 0.0), np.where(here, y - self.my, 0.0)
        part = self.n / np.maximum(n, 1.0)
        return CoMoments(n, self.mx + dx / np.maximum(n, 1.0), self.my + dy / np.maximum(n, 1.0),
                         self.xx + dx * dx * part, self.yy + dy * dy * part, self.xy + dx * dy * part)

    def merged(self, b: "CoMoments") -> "CoMoments":
        n = self.n + b.n
        both = (self.n > 0) & (b.n > 0)
        dx, dy = np.where(both, b.mx - self.mx, 0.0), np.where(both, b.my - self.my, 0.0)
        part, share = self.n * b.n / np.maximum(n, 1.0), b.n / np.maximum(n, 1.0)
        return CoMoments(n, np.where(self.n > 0, self.mx, b.mx) + dx * share, np.where(self.n > 0, self.my, b.my) + dy * share,
                         self.xx + b.xx + dx * dx * part, self.yy + b.yy + dy * dy * part, self.xy + b.xy + dx * dy * part)


class Segments:
    """Groups of rows laid out as segments of ``w`` rows, the last one of each group padded."""

    def __init__(self, starts: np.ndarray, lengths: np.ndarray, w: int):
        self.w = w
        per = -(-lengths // w)
        first = np.cumsum(per) - per
        self.count = int(per.sum())
        self.row = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))
        local = self.row - np.repeat(starts, lengths)
        self.place = (np.repeat(first, lengths) + local // w) * w + local % w
        self.alone = np.zeros(self.count, dtype=bool)                      # nothing before this segment
        self.alone[first] = True

    def spread(self, x: np.ndarray) -> np.ndarray:
        out = np.full(self.count * self.w, np.nan)
        out[self.place] = x[self.row]
        return out.reshape(self.count, self.w)

    def rest(self, suffix: np.ndarray, empty: float) -> np.ndarray:
        """What of the segment before belongs to the frame that ends at each place; ``suffix``: from each place to its segment's end."""
        out = np.full((self.count, self.w), empty)
        if self.count > 1:
            out[1:, :-1] = suffix[:-1, 1:]
        out[self.alone] = empty
        return out

    def back(self, x: np.ndarray) -> np.ndarray:
        return x.reshape(-1)[self.place]


def _running(none, columns: list[np.ndarray], backwards: bool):
    """States after each place of a segment, one place at a time for all segments, as arrays segment x place."""
    w = columns[0].shape[1]
    state = none
    out = [np.empty_like(columns[0]) for _ in state.arrays()]
    for t in range(w - 1, -1, -1) if backwards else range(w):
        state = state.plus(*(c[:, t] for c in columns))
        for o, a in zip(out, state.arrays()):
            o[:, t] = a
    return type(state)(*out)


def _framed(seg: Segments, none, columns: list[np.ndarray]):
    before, here = _running(none, columns, True), _running(none, columns, False)
    return type(none)(*(seg.rest(a, 0.0) for a in before.arrays())).merged(here)


def _extreme(seg: Segments, x: np.ndarray, low: bool) -> np.ndarray:
    pick, empty = (np.minimum, np.inf) if low else (np.maximum, -np.inf)
    x = np.where(np.isnan(x), empty, x)
    suffix = pick.accumulate(x[:, ::-1], axis=1)[:, ::-1]
    return pick(seg.rest(suffix, empty), pick.accumulate(x, axis=1))


def _sum(seg: Segments, x: np.ndarray) -> np.ndarray:
    x = np.nan_to_num(x)
    return seg.rest(np.cumsum(x[:, ::-1], axis=1)[:, ::-1], 0.0) + np.cumsum(x, axis=1)


def _count(seg: Segments, x: np.ndarray) -> np.ndarray:
    return _sum(seg, (~np.isnan(x)).astype(float))


def _statistic(stat: str, m: Moments) -> np.ndarray:
    """From moments; a window without spread has skewness 0 and kurtosis -3 (as pandas); NaN where undefined."""
    n = m.n
    with np.errstate(divide="ignore", invalid="ignore"):
        if stat == "mean":
            return np.where(n >= 1, m.mean, np.nan)
        if stat == "std":
            return np.where(n >= 2, np.sqrt(m.m2 / (n - 1)), np.nan)
        flat = m.m2 == 0
        if stat == "skew":
            g = np.sqrt(n) * m.m3 / m.m2 ** 1.5
            return np.where(n >= 3, np.where(flat, 0.0, g * np.sqrt(n * (n - 1)) / (n - 2)), np.nan)
        g = n * m.m4 / m.m2 ** 2 - 3
        return np.where(n >= 4, np.where(flat, -3.0, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6)), np.nan)


def _segment_results(seg: Segments, w: int, frames: list[Frame], values: dict[str, np.ndarray]) -> Iterator[tuple[str, np.ndarray]]:
    for col in dict.fromkeys(f.col for f in frames):
        own = [f for f in frames if f.col == col]
        x = seg.spread(values[col])
        plain = [f for f in own if f.stat != "corr"]
        moments = None
        if any(f.stat in ("mean", "std", "skew", "kurt") for f in plain):
            high = any(f.stat in ("skew", "kurt") for f in plain)
            moments = _framed(seg, Moments.none(seg.count, high), [x])
        count = moments.n if moments else _count(seg, x)
        for f in plain:
            if f.stat in ("min", "max"):
                out = _extreme(seg, x, f.stat == "min")
            elif f.stat == "sum":
                out = _sum(seg, x)
            else:
                out = _statistic(f.stat, moments)
            yield f.name, np.where(count >= max(f.least, 1), out, np.nan)
        for f in (f for f in own if f.stat == "corr"):
            m = _framed(seg, CoMoments.none(seg.count), [x, seg.spread(values[f.other])])
            with np.errstate(divide="ignore", invalid="ignore"):
                out = np.where((m.xx > 0) & (m.yy > 0), m.xy / np.sqrt(m.xx * m.yy), np.nan)
            yield f.name, np.where(m.n >= max(f.least, 2), out, np.nan)


def frame_columns(starts: np.ndarray, total: int, frames: Sequence[Frame], values: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The frames' columns for groups of consecutive rows that begin at ``starts``; NaN: none."""
    out = {f.name: np.full(total, np.nan) for f in frames}
    lengths = np.diff(np.append(starts, total))
    size = np.ceil(np.log2(np.maximum(lengths, 1)) / 2).astype(int)        # groups up to 1, 4, 16, 64, ... rows
    for s in np.unique(size):
        pick = size == s
        for n in sorted({f.n for f in frames}):
            w = min(n, int(lengths[pick].max()))
            seg = Segments(starts[pick], lengths[pick], w)
            for name, x in _segment_results(seg, w, [f for f in frames if f.n == n], values):
                out[name][seg.row] = seg.back(x)
    return out


def trailing_frames(df: DataFrame, spec: SeriesSpec, frames: Sequence[Frame], positioned: bool = False, keep_pos: bool = False) -> DataFrame:
    """``df`` with one column per frame: the statistic of the current row and the ``n - 1`` before it in its series."""
    frames = list(frames)
    small = replace(spec, block_rows=min(spec.block_rows, BLOCK_ROWS))
    pos = df if positioned else with_positions(df, spec)
    need = list(dict.fromkeys(c for f in frames for c in (f.col, f.other) if c))
    numbers = [F.col(c).cast("double").alias(f"_v_{i}") for i, c in enumerate(need)]
    halo = blocked(pos, small, max(f.n for f in frames) - 1)
    dealt = halo.select(*pos.columns, CORE, F.xxhash64(*spec.keys, BLK).alias("_g"), *[F.col(k).alias(f"_k_{k}") for k in spec.keys], BLK, *numbers)
    by = [*(f"_k_{k}" for k in spec.keys), BLK]
    dealt = dealt.repartition(*by).sortWithinPartitions(*by, POS).drop(*by)
    kept = [c for c in pos.columns if keep_pos or c != POS]
    schema = T.StructType([df.schema[c] if c in df.columns else pos.schema[c] for c in kept] + [T.StructField(f.name, T.DoubleType()) for f in frames])

    def result(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        values = {c: rows[f"_v_{i}"].to_numpy() for i, c in enumerate(need)}
        found = frame_columns(starts, rows.num_rows, frames, values)
        core = rows[CORE].to_numpy()
        table = rows.select(kept).filter(rows[CORE])
        for f in frames:
            table = table.append_column(f.name, pa.array(found[f.name][core], from_pandas=True))
        yield from table.combine_chunks().to_batches(max_chunksize=10_000)

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= BUFFER_ROWS:
                rows = pa.Table.from_batches(held)
                starts = _starts(rows)
                if len(starts) > 1:                                        # the last block may go on
                    cut = int(starts[-1])
                    yield from result(rows.slice(0, cut).combine_chunks(), starts[:-1])
                    held = rows.slice(cut).combine_chunks().to_batches()
                    size -= cut
        if held and size:
            rows = pa.Table.from_batches(held).combine_chunks()
            yield from result(rows, _starts(rows))

    return dealt.mapInArrow(run, schema)


def _starts(rows: pa.Table) -> np.ndarray:
    """Where a new block begins: another hash of (series, block), or positions that don't follow each other."""
    g, p = rows["_g"].to_numpy(), rows[POS].to_numpy()
    return np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (p[1:] != p[:-1] + 1))))
