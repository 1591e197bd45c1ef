"""Iterative fits as programs of additive steps.

A learner is a *program*: a generator that yields requests and gets their
answers.  A request says what to work out on a block of training rows
(``partial``), how two partial results are put together (``combine``) and what
small answer follows from the whole (``finish``).  Programs never see the
rows, so it does not matter where they run:

* Rows beyond ``local_bytes``: all programs advance in step.  One Spark job per
  step maps every partition's blocks to partial results, sums them per
  program in a shuffle, and returns the answers only (splits of a tree, an updated
  network's gradients).  Histograms of all partitions never meet on the driver.
* Rows up to ``local_bytes`` (their measured size) are broadcast and each program is one
  row of one job, run to its end by the same code.  A search of a hundred
  fits is then one job of a hundred parallel tasks.

Randomness is taken from hashes of row keys and from seeded generators, so
models depend neither on the way nor on the partitioning (but for the order
of floating-point sums).
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirro.session import cut_lineage

BLOCK_ROWS = 2048
LOCAL_BYTES = 64 << 20
TASK_BLOCKS = 128                     # of a partition at most, where there are more than cores
NONE, TRAIN, TEST = 0, 1, 2


@dataclass
class Block:
    """Rows of the training table; ``role``: one line of NONE/TRAIN/TEST per set of rows."""
    number: int
    x: np.ndarray
    bins: np.ndarray
    y: np.ndarray
    key: np.ndarray
    role: np.ndarray
    run: str = ""
    known: dict = field(default_factory=dict)

    def of(self, which: int) -> np.ndarray:
        return np.flatnonzero(self.role[which] == TRAIN)

    def columns(self) -> np.ndarray:
        """Bins with each feature's together."""
        return self.once(("columns",), lambda: np.ascontiguousarray(self.bins.T))

    def once(self, key: tuple, made: Callable[[], np.ndarray]) -> np.ndarray:
        """What several programs or steps ask of a block's rows; the last value of each kind and seed, of forests that of each tree."""
        kept, rest = (key, ()) if key[0] == "times" else (key[:2], key[2:])
        if self.known.get(kept, (None,))[0] != rest:
            self.known[kept] = (rest, made())
        return self.known[kept][1]


@dataclass
class Request:
    partial: Callable[[Block], list[np.ndarray]]
    finish: Callable[[list[np.ndarray]], object] = lambda sums: sums
    combine: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.add

    def put(self, a: list | None, b: list) -> list:
        return b if a is None else [self.combine(x, y) for x, y in zip(a, b)]


@dataclass
class Fit:
    """One program to run: ``program(which, n_features, **params)`` is a generator that returns a model."""
    program: Callable
    which: int
    params: dict = field(default_factory=dict)


def uniform(key: np.ndarray, *salt: int) -> np.ndarray:
    """[0, 1) from 64-bit keys."""
    h = key.astype(np.uint64)
    for s in (*salt, 0x5851F42D):
        h = h ^ np.uint64((s * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(31))
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


@dataclass
class Table:
    """Training rows in blocks, and the cut points of each feature's bins."""
    blocks: DataFrame
    edges: list[np.ndarray]
    n_sets: int

    @property
    def width(self) -> int:
        return len(self.edges)


def training_table(rows: DataFrame, features: Sequence[str], label: str, key: str, roles: Sequence[str], bins: int = 32) -> Table:
    """``rows`` as blocks.  ``roles``: one column of 0 (none), 1 (train) or 2 (test) per set; cut points are
    approximate quantiles of all rows that train in some set."""
    features, roles = list(features), list(roles)
    used = F.greatest(*[F.when(F.col(r) == TRAIN, 1).otherwise(0) for r in roles], F.lit(0)) == 1
    points = [i / bins for i in range(1, bins)]
    found = rows.filter(used).agg(*[F.percentile_approx(F.col(c).cast("double"), points, 10_000).alias(f"q{i}") for i, c in enumerate(features)]).first()
    edges = [np.unique(np.array(q, dtype=float)) if q else np.zeros(0) for q in found]
    flat = rows.select(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]).alias("x"), F.col(label).cast("double").alias("y"),
                       F.xxhash64(key).alias("k"), F.array(*[F.coalesce(F.col(r), F.lit(0)).cast("int") for r in roles]).alias("r"))
    n, s = len(features), len(roles)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                b = batch.slice(a, BLOCK_ROWS)
                x = np.asarray(b.column("x").flatten(), dtype=float).reshape(-1, n)
                binned = np.empty(x.shape, dtype=np.uint8)
                for i, e in enumerate(edges):
                    binned[:, i] = np.searchsorted(e, x[:, i], side="left")
                role = np.asarray(b.column("r").flatten(), dtype=np.uint8).reshape(-1, s).T
                cols = [x.tobytes(), binned.tobytes(), np.asarray(b.column("y"), dtype=float).tobytes(), b.column("k").to_numpy().tobytes(), np.ascontiguousarray(role).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int32()), *(pa.array([c], pa.binary()) for c in cols)], names=["n", "x", "bins", "y", "key", "role"])

    # Every partition sends its own sums in each step: as few as the cores and the size of one allow.
    count = -(-rows.count() // BLOCK_ROWS)
    blocks = flat.repartition(max(1, min(rows.sparkSession.sparkContext.defaultParallelism, count), -(-count // TASK_BLOCKS))).mapInArrow(
        run, "n int, x binary, bins binary, y binary, key binary, role binary")
    return Table(cut_lineage(blocks.withColumn("number", F.monotonically_increasing_id())), edges, s)


def _decoded(batch, width: int, n_sets: int, run: str) -> Iterator[Block]:
    for i in range(batch.num_rows):
        n, number = (batch.column(c)[i].as_py() for c in ("n", "number"))
        x, bins, y, key, role = (batch.column(c)[i].as_buffer() for c in ("x", "bins", "y", "key", "role"))
        yield Block(number, np.frombuffer(x).reshape(n, width), np.frombuffer(bins, np.uint8).reshape(n, width), np.frombuffer(y),
                    np.frombuffer(key, np.int64).view(np.uint64), np.frombuffer(role, np.uint8).reshape(n_sets, n), run)


def fit_all(table: Table, fits: Sequence[Fit], local_bytes: int = LOCAL_BYTES) -> list:
    """The models of all fits, in order."""
    fits, spark, run = list(fits), table.blocks.sparkSession, uuid.uuid4().hex
    size = table.blocks.agg(F.sum(F.octet_length("x") + F.octet_length("bins") + F.octet_length("key") * 2)).first()[0] or 0
    if not fits:
        return []
    if size <= local_bytes:
        held = spark.sparkContext.broadcast(table.blocks.toArrow())
        width, n_sets = table.width, table.n_sets

        def alone(batches):
            blocks = [b for batch in held.value.to_batches() for b in _decoded(batch, width, n_sets, run)]
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    model = _run_local(fits[i], blocks, width)
                    yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([pickle.dumps(model)], pa.binary())], names=["i", "model"])

        tasks = spark.range(len(fits)).repartitionByRange(len(fits), "id")
        got = {r["i"]: pickle.loads(r["model"]) for r in tasks.mapInArrow(alone, "i long, model binary").collect()}      # models only
        held.destroy()
        return [got[i] for i in range(len(fits))]
    return _in_step(table, fits, run)


def _run_local(fit: Fit, blocks: list[Block], width: int):
    program = fit.program(fit.which, width, **fit.params)
    try:
        request = next(program)
        while True:
            sums = None
            for b in blocks:
                sums = request.put(sums, request.partial(b))
            request = program.send(request.finish(sums))
    except StopIteration as end:
        return end.value


def _in_step(table: Table, fits: list[Fit], run: str) -> list:
    programs = [f.program(f.which, table.width, **f.params) for f in fits]
    models: list = [None] * len(fits)
    waiting: dict[int, Request] = {}
    width, n_sets = table.width, table.n_sets

    def advance(i, answer=None, first=False):
        try:
            waiting[i] = next(programs[i]) if first else programs[i].send(answer)
        except StopIteration as end:
            waiting.pop(i, None)
            models[i] = end.value

    for i in range(len(fits)):
        advance(i, first=True)
    while waiting:
        asked = dict(waiting)

        def partials(batches):
            sums: dict[int, list] = {}
            for batch in batches:
                for block in _decoded(batch, width, n_sets, run):
                    for i, r in asked.items():
                        sums[i] = r.put(sums.get(i), r.partial(block))
            for i, s in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([pickle.dumps(s)], pa.binary())], names=["i", "part"])

        def whole(t: pa.Table) -> pa.Table:
            i, sums = t["i"][0].as_py(), None
            for part in t["part"]:
                sums = asked[i].put(sums, pickle.loads(part.as_py()))
            return pa.table({"i": [i], "answer": pa.array([pickle.dumps(asked[i].finish(sums))], pa.binary())})

        answers = table.blocks.mapInArrow(partials, "i long, part binary").groupBy("i").applyInArrow(whole, "i long, answer binary").collect()
        for r in answers:
            advance(r["i"], pickle.loads(r["answer"]))
    return models


def predictions(rows: DataFrame, features: Sequence[str], models: dict[str, object]) -> DataFrame:
    """``rows`` with one column per model: its raw probability of class 1.  All models in one pass."""
    names, features = list(models), list(features)
    held = rows.sparkSession.sparkContext.broadcast(models)
    kept = rows.columns
    x = rows.withColumn("_px", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]))

    def run(batches):
        for batch in batches:
            v = np.asarray(batch.column(batch.num_columns - 1).flatten(), dtype=float).reshape(-1, len(features))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(np.asarray(held.value[m].probability(v), dtype=float)) for m in names)], names=[*kept, *names])

    schema = rows.schema
    for m in names:
        schema = schema.add(m, "double")
    return x.mapInArrow(run, schema)


def test_confusion(table: Table, tested: Sequence[tuple[int, object]], threshold: float = 0.5) -> list[tuple[float, float, float]]:
    """(tp, fp, fn) of each (set, model) on the set's test rows, all in one pass."""
    tested = list(tested)
    held = table.blocks.sparkSession.sparkContext.broadcast(tested)
    width, n_sets = table.width, table.n_sets

    def run(batches):
        out = np.zeros((len(tested), 3))
        for batch in batches:
            for b in _decoded(batch, width, n_sets, ""):
                for i, (which, model) in enumerate(held.value):
                    at = np.flatnonzero(b.role[which] == TEST)
                    if len(at):
                        said, true = model.probability(b.x[at]) >= threshold, b.y[at] == 1
                        out[i] += [(said & true).sum(), (said & ~true).sum(), (~said & true).sum()]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(tested)), pa.int64()), *(pa.array(out[:, c]) for c in range(3))], names=["i", "tp", "fp", "fn"])

    got = table.blocks.mapInArrow(run, "i long, tp double, fp double, fn double").groupBy("i").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).collect()
    by = {r["i"]: (r["tp"], r["fp"], r["fn"]) for r in got}
    return [by[i] for i in range(len(tested))]
