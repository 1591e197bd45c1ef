"""Near-duplicate vectors by collision-counting projections.

Every vector is projected on many random directions.  Two vectors of
cosine 0.9 are close on each of them, unrelated ones on few: with both
sorted by a direction, the window centred on one vector holds the other
(a *collision*) with a known probability.  Pairs whose number of
collisions over all ``projections`` reaches a count calibrated to keep
pairs at the threshold (all but ``miss`` of them) are verified by their
cosine in double precision, so no pair below the threshold is linked.

One-dimensional windows alone hold a fixed share of all pairs, however
many projections there are.  So counting is done inside cells: in each of
``tables`` tables the cell of a vector is the pair of projections (with
sign) on which it lies furthest out, of two sets of ``spread`` further
projections.  Vectors of cosine 0.9 share at least one of the 16 cells
with a probability of about 0.999 (a test measures recall against brute
force).  A pair is counted in the first table whose cell it shares only.

Equal vectors are one node with a count.  A cell of any size is split into
blocks, and pairs of blocks are separate groups; a group gives one link
count per vector and a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirro.llm.graph import components
from cirro.llm.storage import drop, stage


def directions(dim: int, tables: int, spread: int, projections: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(tables, 2, spread, dim) directions for cells and (projections, dim) for counting."""
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((tables, 2, spread, dim)), rng.standard_normal((projections, dim))


def shared_extreme(least: float, spread: int, trials: int = 20000) -> float:
    """Probability that two vectors of cosine ``least`` lie furthest out on the same of ``spread`` random directions, with the same sign."""
    rng = np.random.default_rng(spread)
    a = rng.standard_normal((trials, spread))
    b = least * a + math.sqrt(1 - least * least) * rng.standard_normal((trials, spread))
    i, j = np.abs(a).argmax(axis=1), np.abs(b).argmax(axis=1)
    rows = np.arange(trials)
    return float(((i == j) & (np.sign(a[rows, i]) == np.sign(b[rows, j]))).mean())


def cell_plan(n: int, least: float, per_cell: int, miss_cells: float) -> tuple[int, int]:
    """(spread, tables) for n vectors: (2 spread)^2 cells a table, 1,024 at least; tables enough for the miss, 16 at least."""
    spread = max(16, math.ceil(math.sqrt(n / per_cell) / 2))
    p = min(0.999, max(1e-6, shared_extreme(least, spread, 20000 if spread <= 256 else 4000) ** 2))
    return spread, max(16, math.ceil(math.log(miss_cells) / math.log(1 - p)))


def calibrated(least: float, projections: int, half_width: float, miss: float) -> int:
    """Largest count that a pair of cosine ``least`` reaches with a probability of 1 - miss at least."""
    p = math.erf(half_width / math.sqrt(2 * (2 - 2 * least)) )
    below, count = 0.0, 0
    while count < projections:
        below += math.comb(projections, count) * p**count * (1 - p)**(projections - count)
        if below > miss:
            break
        count += 1
    return count


def collisions(hq: np.ndarray, hx: np.ndarray, half_width: float) -> np.ndarray:
    """(queries, vectors) number of directions whose query-centred window holds the vector."""
    out = np.zeros((hq.shape[1], hx.shape[1]), dtype=np.int16)
    q = np.arange(hq.shape[1])
    for a, b in zip(hq, hx):
        order = np.argsort(b, kind="stable")
        line = b[order]
        step = np.zeros((len(a), len(b) + 1), dtype=np.int8)     # a window is an interval of the sorted line
        np.add.at(step, (q, np.searchsorted(line, a - half_width, "left")), 1)
        np.add.at(step, (q, np.searchsorted(line, a + half_width, "right")), -1)
        back = np.empty(len(b), dtype=np.int64)
        back[order] = np.arange(len(b))
        out += np.cumsum(step[:, :-1], axis=1, dtype=np.int8)[:, back]
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)                 # keeps the squares finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position linked with each of n positions by the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def vector_links(vectors: DataFrame, least: float = 0.9, tables: int | None = None, spread: int | None = None, projections: int = 32,
                 half_width: float = 0.55, miss: float = 1e-4, block: int = 1024, seed: int = 3, per_cell: int = 64, miss_cells: float = 1e-3) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    ``vectors`` needs vec_id and embedding (array of float or double).
    Vectors that are null, empty, zero, or hold null or non-finite
    components link with nothing, nor do vectors of different lengths or
    rows without vec_id.  Equal vectors link with each other; rows that
    repeat a vec_id are vectors of their own in the counts and one node in
    the components.  Other columns are ignored; an empty table gives no rows.
    """
    kind = np.float32 if "float" in dict(vectors.dtypes)["embedding"] else np.float64
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    usable = rows.where(F.coalesce(good, F.lit(False)))
    nodes = stage(usable.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("times")), "vectors")

    plan = cell_plan(nodes.count(), least, per_cell, miss_cells)
    spread, tables = spread or plan[0], tables or plan[1]

    def keyed(batches):
        for batch in batches:
            emb = batch.column(2)
            size = np.diff(emb.offsets.to_numpy())
            flat = emb.flatten().to_numpy(zero_copy_only=False).astype(kind)
            start = np.cumsum(size) - size
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                x = flat[start[at][:, None] + np.arange(dim)]
                cell, _ = directions(int(dim), tables, spread, projections, seed)
                u = unit(x.astype(np.float64))
                keys = np.zeros((len(at), tables), dtype=np.int32)
                for t in range(tables):
                    code = np.zeros(len(at), dtype=np.int64)
                    for half in cell[t]:
                        h = u @ half.T
                        far = np.abs(h).argmax(axis=1)
                        code = code * (2 * spread) + 2 * far + (h[np.arange(len(at)), far] > 0)
                    keys[:, t] = code
                raw, key_bytes = x.tobytes(), keys.tobytes()
                w, kw = x.itemsize * int(dim), 4 * tables
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(np.full(len(at), dim, np.int32)),
                     pa.array([raw[i * w:(i + 1) * w] for i in range(len(at))], pa.binary()),
                     pa.array([key_bytes[i * kw:(i + 1) * kw] for i in range(len(at))], pa.binary()),
                     pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * tables, pa.array(keys.reshape(-1)))],
                    names=["rep", "times", "dim", "x", "keys", "cells"])

    placed = stage(nodes.select("rep", "times", "embedding").mapInArrow(
        keyed, "rep long, times long, dim int, x binary, keys binary, cells array<int>"), "cells")
    cell = ["dim", "t", "cell"]
    spots = placed.select("rep", "dim", F.posexplode("cells").alias("t", "cell"))
    sizes = spots.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    full = placed.select("rep", "times", "dim", "x", "keys", F.posexplode("cells").alias("t", "cell")).join(sizes, cell)
    own = full.withColumn("own", F.pmod(F.xxhash64("rep", "x"), F.col("blocks")).cast("int"))
    groups = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *cell, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "times", "x", "keys")
    needed = calibrated(least, projections, half_width, miss)

    def count(table: pa.Table) -> pa.Table:
        dim, t = table["dim"][0].as_py(), table["t"][0].as_py()
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        rep, times, own_block = (table[c].to_numpy() for c in ("rep", "times", "own"))
        u = unit(np.frombuffer(b"".join(table["x"].to_pylist()), kind).reshape(-1, dim).astype(np.float64))
        keys = np.frombuffer(b"".join(table["keys"].to_pylist()), np.int32).reshape(-1, tables)
        _, lines = directions(dim, tables, spread, projections, seed)
        h = lines @ u.T
        left, right = np.flatnonzero(own_block == i), np.flatnonzero(own_block == j)
        found_a, found_b = [], []
        for p in range(0, len(left), 256):
            q = left[p:p + 256]
            hit = collisions(h[:, q], h[:, right], half_width) >= needed
            if i == j:
                hit &= q[:, None] < right[None, :]
            a, b = np.nonzero(hit)
            a, b = q[a], right[b]
            new = ~(keys[a, :t] == keys[b, :t]).any(axis=1)
            a, b = a[new], b[new]
            near = np.einsum("ij,ij->i", u[a], u[b]) >= least
            found_a.append(a[near])
            found_b.append(b[near])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_a, found_b))
        links = np.zeros(len(rep), dtype=np.int64)
        np.add.at(links, a, times[b])
        np.add.at(links, b, times[a])
        on = np.flatnonzero(links)
        return pa.table({"rep": rep[on], "links": links[on], "root": rep[forest(len(rep), a, b)[on]]})

    counted = stage(groups.groupBy(*cell, "i", "j").applyInArrow(count, "rep long, links long, root long"), "links")
    drop(placed)
    totals = counted.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = components(counted.where("rep != root").select(F.col("rep").alias("a"), F.col("root").alias("b"))).select(
        F.col("node").alias("rep"), F.col("component").alias("component_id"))
    info = nodes.join(totals, "rep", "left").join(classes, "rep", "left").select(
        "embedding", F.coalesce("component_id", "rep").alias("component_id"),
        (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    # Staged, so that the join can split the rows of a vector that many rows share.
    linked = usable.join(stage(info, "classes"), "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(good, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
