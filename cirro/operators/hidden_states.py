"""Gaussian hidden-state models of many series.

Each series gets its own model: a chain of K states, Gaussian observations
with full covariances, fitted by expectation maximisation (Baum-Welch).
Sums over all state paths are products of one K x K matrix per row, and so
are, with max and + in place of + and x, the best paths.  Such products can
be taken in pieces:

1. A series is cut into blocks of consecutive rows (exact positions from
   ``plans.layout``).  A block's rows become one matrix, with its logarithmic
   scale kept apart.
2. The matrices of up to ``FAN`` neighbouring blocks are multiplied in one
   task, their products again, until a series is one group; on the way back
   every block learns the state distribution it is entered with and the
   likelihood of what follows it (``scan``).
3. Within a block rows are walked through in pieces of about the square root
   of its length, all pieces at once.

A fitting round sums each block's statistics per series (partial aggregates)
and updates one row of parameters per series.  Series that are one block need
no exchange between blocks: their rounds run to the end within a task.  So a
series of any length is spread over tasks, and millions of short ones cost one pass.

Rows with a missing observation say nothing about the state: the chain runs
through them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cirro.plans.layout import with_positions
from cirro.plans.series import BLK, POS, SeriesSpec
from cirro.session import cut_lineage

SID = "_sid"                       # all key columns as one struct: equal where nulls are, too
FAN = 1024
PRIOR = 0.01                       # added to the covariance sums' diagonal
NEVER = -1e300


@dataclass
class Model:
    """Parameters of one series' chain."""
    start: np.ndarray              # K
    move: np.ndarray               # K x K
    mean: np.ndarray               # K x D
    cov: np.ndarray                # K x D x D

    def flat(self) -> list[float]:
        return np.concatenate([x.ravel() for x in (self.start, self.move, self.mean, self.cov)]).tolist()

    @staticmethod
    def of(flat, k: int, d: int) -> "Model":
        a = np.asarray(flat, dtype=float)
        cut = np.cumsum([k, k * k, k * d])
        s, m, mu, c = np.split(a, cut)
        return Model(s, m.reshape(k, k), mu.reshape(k, d), c.reshape(k, d, d))

    @property
    def by_volatility(self) -> np.ndarray:
        """States by the trace of their covariance, the most volatile last."""
        return np.argsort(np.trace(self.cov, axis1=1, axis2=2), kind="stable")


def log_density(x: np.ndarray, model: Model) -> np.ndarray:
    """n x K; rows with a missing value (NaN) have density 1 in every state."""
    n, d = x.shape
    out = np.zeros((n, len(model.start)))
    whole = ~np.isnan(x).any(axis=1)
    for k, (mean, cov) in enumerate(zip(model.mean, model.cov)):
        low = np.linalg.cholesky(cov)
        z = np.linalg.solve(low, (x[whole] - mean).T)
        out[whole, k] = -0.5 * (z * z).sum(axis=0) - np.log(np.diag(low)).sum() - 0.5 * d * np.log(2 * np.pi)
    return out


class Pieces:
    """The rows of a block, cut into pieces of equal length that are walked through side by side."""

    def __init__(self, x: np.ndarray, first: bool, model: Model):
        self.n, self.k, self.model = len(x), len(model.start), model
        self.width = max(1, int(np.ceil(np.sqrt(self.n))))
        self.count = -(-self.n // self.width)
        pad = self.count * self.width - self.n
        log_b = np.vstack([log_density(x, model), np.zeros((pad, self.k))])
        self.peak = log_b.max(axis=1).reshape(self.count, self.width)
        self.log_b = log_b.reshape(self.count, self.width, self.k)
        self.b = np.exp(self.log_b - self.peak[:, :, None])
        self.real = (np.arange(self.count * self.width) < self.n).reshape(self.count, self.width)
        self.first = first

    def step(self, t: int) -> np.ndarray:
        """The matrices of the t-th row of all pieces, without their scale; rows that aren't there change nothing."""
        w = self.model.move[None] * self.b[:, t, None, :]
        if self.first and t == 0:                       # whatever came before, the series starts here
            w[0] = self.model.start[None, :] * self.b[0, 0][None, :]
        w[~self.real[:, t]] = np.eye(self.k)
        return w

    def log_step(self, t: int) -> np.ndarray:
        with np.errstate(divide="ignore"):
            move, start = np.maximum(np.log(self.model.move), NEVER), np.maximum(np.log(self.model.start), NEVER)
        w = move[None] + self.log_b[:, t, None, :]
        if self.first and t == 0:
            w[0] = start[None, :] + self.log_b[0, 0][None, :]
        w[~self.real[:, t]] = np.where(np.eye(self.k, dtype=bool), 0.0, NEVER)
        return w

    def products(self) -> tuple[np.ndarray, np.ndarray]:
        """Each piece's matrix product, scaled to 1 at most, and the logarithms of the scales."""
        out, log = np.broadcast_to(np.eye(self.k), (self.count, self.k, self.k)), np.zeros(self.count)
        for t in range(self.width):
            out = out @ self.step(t)
            top = out.max(axis=(1, 2))
            out = out / top[:, None, None]
            log += np.log(top) + np.where(self.real[:, t], self.peak[:, t], 0.0)
        return out, log

    def log_products(self) -> np.ndarray:
        out = np.broadcast_to(np.where(np.eye(self.k, dtype=bool), 0.0, NEVER), (self.count, self.k, self.k))
        for t in range(self.width):
            out = (out[:, :, :, None] + self.log_step(t)[:, None]).max(axis=2)
        return out


def product(mats: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, float]:
    """The product of scaled matrices in order."""
    out, log = np.eye(mats.shape[1]), 0.0
    for m, c in zip(mats, logs):
        out = out @ m
        top = out.max()
        out /= top
        log += c + np.log(top)
    return out, log


def enter_and_leave(mats: np.ndarray, enter: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each of a row of matrices is entered with (a distribution) and what follows it (a likelihood of sum 1)."""
    n, k = len(mats), mats.shape[1]
    fore, aft = np.empty((n, k)), np.empty((n, k))
    v, u = enter / enter.sum(), leave / leave.sum()
    for i in range(n):
        fore[i] = v
        v = v @ mats[i]
        v /= v.sum()
    for i in range(n - 1, -1, -1):
        aft[i] = u
        u = mats[i] @ u
        u /= u.sum()
    return fore, aft


def best_enter_and_leave(mats: np.ndarray, enter: np.ndarray, leave: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Best score of each state before every matrix, and the state after it on the best path (the lowest of equal ones)."""
    n, k = len(mats), mats.shape[1]
    fore, aft = np.empty((n, k)), np.empty(n, dtype=np.int64)
    v = enter
    for i in range(n):
        fore[i] = v
        v = (v[:, None] + mats[i]).max(axis=0)
        v = v - v.max()
    state = int(v.argmax()) if leave is None else leave
    for i in range(n - 1, -1, -1):
        aft[i] = state
        state = int((fore[i] + mats[i][:, state]).argmax())
    return fore, aft


def walk(p: Pieces, enter: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """(posterior of each row and state, expected moves, log likelihood, posterior given the rows up to each row) of a block."""
    mats, _ = p.products()
    fore, aft = enter_and_leave(mats, enter, leave)
    alpha, before = np.empty((p.count, p.width, p.k)), np.empty((p.count, p.width, p.k))
    v, log = fore, 0.0
    for t in range(p.width):
        before[:, t] = v
        v = (v[:, None, :] @ p.step(t))[:, 0]
        total = v.sum(axis=1)
        v = v / total[:, None]
        log += (np.log(total) + np.where(p.real[:, t], p.peak[:, t], 0.0)).sum()
        alpha[:, t] = v
    gamma, moves, u = np.empty((p.count, p.width, p.k)), np.zeros((p.k, p.k)), aft
    for t in range(p.width - 1, -1, -1):
        g = alpha[:, t] * u
        gamma[:, t] = g / g.sum(axis=1, keepdims=True)
        w = p.step(t)
        xi = before[:, t, :, None] * w * u[:, None, :]
        xi /= xi.sum(axis=(1, 2), keepdims=True)
        counted = p.real[:, t].copy()
        if p.first and t == 0:
            counted[0] = False
        moves += xi[counted].sum(axis=0)
        u = (w @ u[:, :, None])[:, :, 0]
        u = u / u.sum(axis=1, keepdims=True)
    return gamma.reshape(-1, p.k)[:p.n], moves, log, alpha.reshape(-1, p.k)[:p.n]


def best_path(p: Pieces, enter: np.ndarray, leave: int | None) -> np.ndarray:
    """The most likely states of a block's rows."""
    fore, exits = best_enter_and_leave(p.log_products(), enter, leave)
    came = np.empty((p.count, p.width, p.k), dtype=np.int64)
    v, each = fore, np.arange(p.count)
    for t in range(p.width):
        ways = v[:, :, None] + p.log_step(t)
        came[:, t] = ways.argmax(axis=1)
        v = ways.max(axis=1)
    states, s = np.empty((p.count, p.width), dtype=np.int64), exits
    for t in range(p.width - 1, -1, -1):
        states[:, t] = s
        s = came[each, t, s]
    return states.reshape(-1)[:p.n]


# --- expectation and maximisation -----------------------------------------------------------
def statistics(x: np.ndarray, first: bool, model: Model, enter: np.ndarray, leave: np.ndarray) -> np.ndarray:
    """Log likelihood, expected start, moves, and per state the count, sum and sum of products of its whole rows."""
    gamma, moves, log, _ = walk(Pieces(x, first, model), enter, leave)
    whole = ~np.isnan(x).any(axis=1)
    g, z = gamma[whole], x[whole]
    start = gamma[0] if first else np.zeros(len(model.start))
    return np.concatenate([[log], start, moves.ravel(), g.sum(axis=0), (g.T @ z).ravel(), np.einsum("nk,ni,nj->kij", g, z, z).ravel()])


def updated(sums: np.ndarray, model: Model) -> Model:
    k, d = model.mean.shape
    start, moves, count, total, products = np.split(sums[1:], np.cumsum([k, k * k, k, k * d]))
    moves, total, products = moves.reshape(k, k), total.reshape(k, d), products.reshape(k, d, d)
    out = moves.sum(axis=1, keepdims=True)
    seen = count > 1e-12
    count_ = np.where(seen, count, 1.0)
    mean = np.where(seen[:, None], total / count_[:, None], model.mean)
    spread = products - np.einsum("k,ki,kj->kij", count, mean, mean) + PRIOR * np.eye(d)
    cov = np.where(seen[:, None, None], spread / np.maximum(count_, 1.0)[:, None, None], model.cov)
    return Model(start / start.sum(), np.where(out > 0, moves / np.where(out > 0, out, 1.0), model.move), mean, (cov + cov.transpose(0, 2, 1)) / 2)


def first_model(cov: np.ndarray, k: int) -> Model:
    """Means along the main direction of a standardised series, one covariance for all states, even moves."""
    d = len(cov)
    values, vectors = np.linalg.eigh(cov)
    main = vectors[:, -1] * np.sign(vectors[np.abs(vectors[:, -1]).argmax(), -1])
    mean = np.linspace(-1, 1, k)[:, None] * np.sqrt(max(values[-1], PRIOR)) * main[None, :]
    return Model(np.full(k, 1 / k), np.full((k, k), 1 / k), mean, np.repeat((cov + PRIOR * np.eye(d))[None], k, axis=0))


def fit_one(x: np.ndarray, model: Model, max_iter: int, tol: float) -> tuple[Model, float]:
    """All rounds of a series that is one block."""
    k, log = len(model.start), -np.inf
    for _ in range(max_iter):
        sums = statistics(x, True, model, np.ones(k), np.ones(k))
        gain, log = sums[0] - log, sums[0]
        model = updated(sums, model)
        if gain < tol:
            break
    return model, log


# --- blocks in Spark --------------------------------------------------------------------------
def known(c: str) -> Column:
    """The column as double; null, NaN and infinities as NaN."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x).otherwise(float("nan"))


def _rows(df: DataFrame, spec: SeriesSpec, cols: Sequence[str], min_rows: int, fit_mask: str | None = None) -> DataFrame:
    """``df`` with position, block, series id, length and standardised observations (``_z``, NaN where missing)."""
    pos = with_positions(df, spec, length="_len")
    pos = pos.withColumn(SID, F.struct(*spec.keys)).withColumn(BLK, F.floor((F.col(POS) - 1) / spec.block_rows).cast("long"))
    x = [known(c) for c in cols]
    whole = ~F.exists(F.array(*x), F.isnan)
    pos = pos.withColumn("_x", F.array(*x)).withColumn("_whole", whole)
    st = pos.filter(F.col("_whole") & (F.col(fit_mask) if fit_mask else F.lit(True))).groupBy(SID).agg(*[f(F.col("_x")[i]).alias(f"{n}{i}") for i in range(len(cols)) for n, f in (("_m", F.avg), ("_s", F.stddev_pop))])
    mean, sd = (F.array(*[F.col(f"{n}{i}") for i in range(len(cols))]) for n in ("_m", "_s"))
    st = st.select(F.col(SID).alias("_st"), mean.alias("_mean"), sd.alias("_sd"))
    j = pos.join(st, pos[SID] == st["_st"], "left").drop("_st")
    z = F.transform("_x", lambda v, i: (v - F.col("_mean")[i]) / F.when(F.col("_sd")[i] > 0, F.col("_sd")[i]).otherwise(1.0))
    return j.withColumn("_z", F.coalesce(z, F.col("_x"))).withColumn("_few", (F.col("_len") < min_rows) | F.col("_mean").isNull()).drop("_x", "_mean", "_sd")


def _blocks(rows: DataFrame) -> DataFrame:
    """One row per block: series, block, its observations in order (``z``), and whether it is the series' only one."""
    g = rows.filter(~F.col("_few")).groupBy(SID, BLK).agg(F.array_sort(F.collect_list(F.struct(POS, "_z"))).alias("r"), F.max("_len").alias("_len"))
    return g.select(SID, BLK, F.flatten(F.col("r._z")).alias("z"), "_len")


def _matrix(v: pa.Array, d: int) -> np.ndarray:
    return np.asarray(v.values, dtype=float).reshape(-1, d)


def _array(values: Sequence) -> pa.Array:
    return pa.array([np.asarray(v, dtype=float).ravel() for v in values], pa.list_(pa.float64()))


def _arrow_kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _first_models(blocks: DataFrame, k: int, d: int) -> DataFrame:
    """series, flat parameters: from the covariance of each standardised series."""
    def sums(batches):
        for b in batches:
            out = []
            for z in b.column("z"):
                x = _matrix(z, d)
                x = x[~np.isnan(x).any(axis=1)]
                out.append(np.concatenate([[len(x)], (x.T @ x).ravel()]))
            yield pa.RecordBatch.from_arrays([b.column(SID), _array(out)], names=[SID, "s"])

    def models(batches):
        for b in batches:
            out = [first_model(np.array(s[1:]).reshape(d, d) / max(s[0], 1.0), k).flat() for s in b.column("s").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(SID), _array(out)], names=[SID, "model"])

    kind = _arrow_kind(blocks, SID)
    parts = blocks.select(SID, "z").mapInArrow(sums, f"{SID} {kind}, s array<double>")
    whole = parts.groupBy(SID).agg(F.array(*[F.sum(F.col("s")[i]) for i in range(1 + d * d)]).alias("s"))
    return whole.mapInArrow(models, f"{SID} {kind}, model array<double>")


def scan(mats: DataFrame, k: int, best: bool = False, fan: int = FAN) -> DataFrame:
    """(series, block, fore, aft) of the matrices (series, block, m, log): how each block is entered and left.

    Sums: a distribution and a likelihood.  Best paths: scores, and the state after the block.
    Groups of ``fan`` blocks are combined in one task, level by level.
    """
    kind = _arrow_kind(mats, SID)
    over = F.floor(F.col(BLK) / fan).cast("long")
    top = mats.agg(F.max(BLK)).first()[0]
    if top is None or top < fan:
        grouped = mats.select("*", F.lit(None).cast("array<double>").alias("fore"), F.lit(None).cast("array<double>").alias("aft"))
        by = [SID]
    else:
        def up(t: pa.Table) -> pa.Table:
            t = t.sort_by(BLK)
            m = np.stack([_matrix(v, k) for v in t["m"].combine_chunks()])
            if best:
                out, log = m[0], 0.0
                for x in m[1:]:
                    out = (out[:, :, None] + x[None]).max(axis=1)
            else:
                out, log = product(m, t["log"].to_numpy())
            return pa.table([t[SID].slice(0, 1), t["_over"].slice(0, 1), _array([out]), pa.array([log])], names=[SID, BLK, "m", "log"])

        above = cut_lineage(mats.withColumn("_over", over).groupBy(SID, "_over").applyInArrow(up, f"{SID} {kind}, {BLK} long, m array<double>, log double"))
        ends = scan(above, k, best, fan).select(F.col(SID).alias("_es"), F.col(BLK).alias("_eb"), "fore", "aft")
        m = mats.withColumn("_over", over)
        grouped = m.join(ends, (m[SID] == ends["_es"]) & (m["_over"] == ends["_eb"])).drop("_es", "_eb")
        by = [SID, "_over"]

    def down(t: pa.Table) -> pa.Table:
        t = t.sort_by(BLK)
        m = np.stack([_matrix(v, k) for v in t["m"].combine_chunks()])
        fore, aft = t["fore"][0].as_py(), t["aft"][0].as_py()
        if best:
            f, a = best_enter_and_leave(m, np.zeros(k) if fore is None else np.array(fore), None if aft is None else int(aft[0]))
            a = a[:, None]
        else:
            f, a = enter_and_leave(m, np.ones(k) if fore is None else np.array(fore), np.ones(k) if aft is None else np.array(aft))
        return pa.table([t[SID], t[BLK], _array(f), _array(a)], names=[SID, BLK, "fore", "aft"])

    return grouped.groupBy(*by).applyInArrow(down, f"{SID} {kind}, {BLK} long, fore array<double>, aft array<double>")


def _with_models(blocks: DataFrame, models: DataFrame) -> DataFrame:
    m = models.select(F.col(SID).alias("_ms"), "model")
    return blocks.join(m, blocks[SID] == m["_ms"]).drop("_ms")


def _block_matrices(blocks: DataFrame, models: DataFrame, k: int, d: int, best: bool = False) -> DataFrame:
    def run(batches):
        for b in batches:
            mats, logs = [], []
            for z, blk, model in zip(b.column("z"), b.column(BLK).to_pylist(), b.column("model").to_pylist()):
                p = Pieces(_matrix(z, d), blk == 0, Model.of(model, k, d))
                if best:
                    m, log = p.log_products(), 0.0
                    out = m[0]
                    for x in m[1:]:
                        out = (out[:, :, None] + x[None]).max(axis=1)
                else:
                    out, log = product(*p.products())
                mats.append(out)
                logs.append(log)
            yield pa.RecordBatch.from_arrays([b.column(SID), b.column(BLK), _array(mats), pa.array(logs)], names=[SID, BLK, "m", "log"])

    return _with_models(blocks, models).select(SID, BLK, "z", "model").mapInArrow(
        run, f"{SID} {_arrow_kind(blocks, SID)}, {BLK} long, m array<double>, log double")


def _round(blocks: DataFrame, models: DataFrame, k: int, d: int) -> DataFrame:
    """One round for series of several blocks: series, new parameters, log likelihood of the old ones."""
    ends = scan(cut_lineage(_block_matrices(blocks, models, k, d)), k).withColumnRenamed(SID, "_es").withColumnRenamed(BLK, "_eb")
    b = _with_models(blocks, models)
    joined = b.join(ends, (b[SID] == ends["_es"]) & (b[BLK] == ends["_eb"])).select(SID, BLK, "z", "model", "fore", "aft")
    size = 1 + k + k * k + k + k * d + k * d * d

    def expect(batches):
        for batch in batches:
            out = [statistics(_matrix(z, d), blk == 0, Model.of(m, k, d), np.array(f), np.array(a)) for z, blk, m, f, a in zip(
                batch.column("z"), *(batch.column(c).to_pylist() for c in (BLK, "model", "fore", "aft")))]
            yield pa.RecordBatch.from_arrays([batch.column(SID), _array(out)], names=[SID, "s"])

    def maximise(batches):
        for batch in batches:
            sums = [np.array(s) for s in batch.column("s").to_pylist()]
            new = [updated(s, Model.of(m, k, d)).flat() for s, m in zip(sums, batch.column("model").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(SID), _array(new), pa.array([float(s[0]) for s in sums])], names=[SID, "model", "log"])

    kind = _arrow_kind(blocks, SID)
    stats = joined.mapInArrow(expect, f"{SID} {kind}, s array<double>").groupBy(SID).agg(F.array(*[F.sum(F.col("s")[i]) for i in range(size)]).alias("s"))
    return _with_models(stats, models).select(SID, "s", "model").mapInArrow(maximise, f"{SID} {kind}, model array<double>, log double")


def fit_models(blocks: DataFrame, k: int, d: int, block_rows: int, max_iter: int, tol: float) -> DataFrame:
    """series, flat parameters.  Rounds end per series when the log likelihood gains less than ``tol``."""
    kind = _arrow_kind(blocks, SID)
    models = cut_lineage(_first_models(blocks, k, d))

    def alone(batches):
        for b in batches:
            out = [fit_one(_matrix(z, d), Model.of(m, k, d), max_iter, tol)[0].flat() for z, m in zip(b.column("z"), b.column("model").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(SID), _array(out)], names=[SID, "model"])

    single, several = (blocks.filter(c) for c in (F.col("_len") <= block_rows, F.col("_len") > block_rows))
    done = _with_models(single, models).select(SID, "z", "model").mapInArrow(alone, f"{SID} {kind}, model array<double>")
    finished = [cut_lineage(done)]
    ids = several.select(F.col(SID).alias("_ms")).distinct()
    going = cut_lineage(models.join(ids, models[SID] == ids["_ms"], "left_semi").withColumn("log", F.lit(float("-inf"))))
    for _ in range(max_iter):
        if going.limit(1).count() == 0:
            break
        new = _round(several, going, k, d)
        old = going.select(F.col(SID).alias("_os"), F.col("log").alias("before"))
        new = cut_lineage(new.join(old, new[SID] == old["_os"]).drop("_os").withColumn("over", ~(F.col("log") - F.col("before") >= tol)))
        finished.append(new.filter("over").select(SID, "model"))
        going = new.filter("NOT over").select(SID, "model", "log")
    out = finished[0]
    for f in [*finished[1:], going.select(SID, "model")]:
        out = out.union(f)
    return cut_lineage(out)


def hidden_states(df: DataFrame, spec: SeriesSpec, cols: Sequence[str], k: int = 3, min_rows: int = 200,
                  max_iter: int = 100, tol: float = 1e-4, fit_mask: str | None = None, smooth: bool = True) -> DataFrame:
    """Every row with ``regime_0..k-1`` (posteriors; states by the trace of their covariance, the most
    volatile last), ``volatile_prob``, ``state`` (of the most likely path) and ``fallback``.

    Series under ``min_rows`` rows, or without a whole row, get uniform
    shares (0.33, ... and the rest; 0.5), and so do series whose model failed
    or collapsed into one state (1/k each) and rows with a missing
    observation; ``fallback`` marks them.  Their ``state`` is null, but for
    rows with a missing observation, which lie on the path.

    With ``fit_mask`` models are fitted on the rows where it is true.  With
    ``smooth=False`` a row's shares follow from the rows up to it only: no later row is looked at.
    """
    cols, d = list(cols), len(cols)
    rows = cut_lineage(_rows(df, spec, cols, min_rows, fit_mask))
    blocks = cut_lineage(_blocks(rows))
    seen = blocks
    if fit_mask:
        unseen = F.array(*[F.lit(float("nan"))] * d)
        seen = cut_lineage(_blocks(rows.withColumn("_z", F.when(F.col(fit_mask), F.col("_z")).otherwise(unseen))))
    models = fit_models(seen, k, d, spec.block_rows, max_iter, tol)
    several = blocks.filter(F.col("_len") > spec.block_rows)
    ends = [scan(cut_lineage(_block_matrices(several, models, k, d, best)), k, best).select(
        F.col(SID).alias(f"_s{n}"), F.col(BLK).alias(f"_b{n}"), F.col("fore").alias(f"fore{n}"), F.col("aft").alias(f"aft{n}")) for n, best in enumerate((False, True))]
    b = _with_models(blocks, models)
    for n, e in enumerate(ends):
        b = b.join(e, (b[SID] == e[f"_s{n}"]) & (b[BLK] == e[f"_b{n}"]), "left").drop(f"_s{n}", f"_b{n}")

    def run(batches):
        names = [SID, BLK, "post", "state"]
        for batch in batches:
            posts, states = [], []
            columns = (batch.column(c).to_pylist() for c in (BLK, "model", "fore0", "aft0", "fore1", "aft1"))
            for z, blk, model, fore, aft, best_fore, best_aft in zip(batch.column("z"), *columns):
                m = Model.of(model, k, d)
                x = _matrix(z, d)
                if not np.isfinite(model).all():
                    posts.append(np.full(len(x) * k, np.nan))
                    states.append(np.full(len(x), -1))
                    continue
                order = m.by_volatility
                p = Pieces(x, blk == 0, m)
                gamma, _, _, filtered = walk(p, np.ones(k) if fore is None else np.array(fore), np.ones(k) if aft is None else np.array(aft))
                path = best_path(p, np.zeros(k) if best_fore is None else np.array(best_fore), None if best_aft is None else int(best_aft[0]))
                posts.append((gamma if smooth else filtered)[:, order].ravel())
                states.append(np.argsort(order)[path])
            yield pa.RecordBatch.from_arrays([batch.column(SID), batch.column(BLK), _array(posts), pa.array([s.tolist() for s in states], pa.list_(pa.int64()))], names=names)

    found = b.select(SID, BLK, "z", "model", "fore0", "aft0", "fore1", "aft1").mapInArrow(
        run, f"{SID} {_arrow_kind(blocks, SID)}, {BLK} long, post array<double>, state array<long>")
    found = cut_lineage(found.select(F.col(SID).alias("_fs"), F.col(BLK).alias("_fb"), "post", F.col("state").alias("path")))
    last = k - 1
    volatile = F.transform(F.sequence(F.lit(0), F.size("path") - 1), lambda i: F.col("post")[i * k + last])
    fell = found.groupBy("_fs").agg((F.min(F.array_min(volatile)) >= 1 - 1e-5 - 1e-8).alias("one"), F.max(F.exists("post", F.isnan)).alias("failed"))
    fell = fell.filter("one OR failed").select(F.col("_fs").alias("_us"))
    by_row = found.select("_fs", "_fb", F.posexplode("path").alias("_i", "state"), "post").select(
        "_fs", (F.col("_fb") * spec.block_rows + F.col("_i") + 1).alias("_fp"), "state", F.slice("post", F.col("_i") * k + 1, F.lit(k)).alias("post"))
    j = rows.join(by_row, (rows[SID] == by_row["_fs"]) & (rows[POS] == by_row["_fp"]), "left")
    j = j.join(fell, j[SID] == fell["_us"], "left")
    collapsed = F.col("_us").isNotNull()
    fallback = F.col("post").isNull() | collapsed | ~F.col("_whole")
    share = [0.33] * (k - 1) + [1 - 0.33 * (k - 1)]
    states = [F.when(collapsed, 1.0 / k).when(fallback, share[i]).otherwise(F.col("post")[i]).alias(f"regime_{i}") for i in range(k)]
    return j.select(*df.columns, *states, F.when(fallback, 0.5).otherwise(F.col("post")[last]).alias("volatile_prob"),
                    F.when(~collapsed, F.col("state")).cast("int").alias("state"), fallback.alias("fallback"))


def two_states(df: DataFrame, spec: SeriesSpec, cols: Sequence[str], min_rows: int = 50, **options) -> DataFrame:
    """The two-state variant: ``state`` on the most likely path, ``volatile`` (the state whose rows vary more,
    per series) and ``volatile_prob``, its posterior (0.5 where there is none)."""
    h = cut_lineage(hidden_states(df, spec, cols, 2, min_rows, **options).withColumn(SID, F.struct(*spec.keys)))
    values = F.inline(F.array(*[F.struct(known(c).alias("v")) for c in cols]))
    var = h.filter(F.col("state").isNotNull()).select(SID, "state", values).filter(~F.isnan("v")).groupBy(SID, "state").agg(F.var_pop("v").alias("var"))
    most = var.groupBy(F.col(SID).alias("_vs")).agg(F.max_by("state", F.struct("var", -F.col("state"))).alias("_volatile"))
    j = h.join(most, h[SID] == most["_vs"], "left")
    share = F.when(F.col("_volatile") == 0, F.col("regime_0")).otherwise(F.col("regime_1"))
    return j.select(*df.columns, "state", (F.col("state") == F.col("_volatile")).alias("volatile"),
                    F.when(F.col("fallback") | F.col("_volatile").isNull(), 0.5).otherwise(share).alias("volatile_prob"))

