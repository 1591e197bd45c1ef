"""Nearest rows without pairs of all rows.

``nearest``  exact, in a few dimensions: reference rows are counted in the cells
    of a pyramid of grids (each cell with the tight box around its rows); all
    points walk down the pyramid at once, level by level.  At each level a
    point keeps the cells that can hold one of its k nearest: those no farther
    than the distance within which the boxes surely hold k rows.  Cells of
    few rows are compared row by row.  A remote point meets the few cells that
    face it, never all rows of a far cluster; of rows at one place only the
    k first by id take part.  Points that lie close together walk as one block
    (its tight box stands for them), so what is moved grows with the blocks;
    points of a block that still faces many rows walk again one by one.
``forest_neighbours``  approximate, in many dimensions: several trees cut the
    rows at quantiles of random projections into leaves of bounded size; rows
    of one leaf are compared, and the best of all trees stay.
    ``measured_recall`` tells the share of the true neighbours found.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cirro.session import cut_lineage

LEAF = 48
BLOCK = 128                           # points that walk together at most
FACED = 64 * LEAF                     # rows a block of several points may face at most


def _total(terms):
    out = F.lit(0.0)
    for t in terms:
        out = out + t
    return out


def nearest(points: DataFrame, refs: DataFrame, dim: int, k: int, exclude_self: bool = False) -> DataFrame:
    """(pid, sid, rank, _d): the ``k`` nearest rows of ``refs`` (sid, s0, s1, ..., maybe sg) for each of
    ``points`` (pid, p0, p1, ..., maybe pg; then only rows with an equal sg count), ties by sid.

    Coordinates are doubles without NULL or NaN; pids and sids are unique.  Points whose group
    has no row are left out; fewer than ``k`` rows are all returned.
    """
    nested = {c for d in (points, refs) for c in d.columns if c in ("pid", "sid", "pg", "sg") and d.schema[c].dataType.simpleString().startswith(("struct", "array", "map"))}
    if nested:
        return _nearest_by_point(points, refs, dim, k, exclude_self)
    grouped = "sg" in refs.columns
    P, S = (d if grouped else d.withColumn(g, F.lit(0)) for d, g in ((points, "pg"), (refs, "sg")))
    want = k + exclude_self
    axes = range(dim)
    same_place = Window.partitionBy("sg", *[f"s{i}" for i in axes]).orderBy("sid")
    S = cut_lineage(S.withColumn("_n", F.row_number().over(same_place)).filter(F.col("_n") <= want).drop("_n"))
    b = S.agg(F.count(F.lit(1)), *[f(f"s{i}") for f in (F.min, F.max) for i in axes]).first()
    kinds = "pid, sid, rank, _d"
    if not b[0]:
        return points.limit(0).select("pid", F.col("pid").alias("sid"), F.lit(0).alias("rank"), F.lit(0.0).alias("_d"))
    low = [b[1 + i] for i in axes]
    extent = max([b[1 + dim + i] - low[i] for i in axes] + [1e-300])
    step = 2 if dim <= 3 else 1
    deepest = step * math.ceil((math.log2(b[0] + 1) / dim + 6) / step)
    # Every level's cells in one pass: counts and boxes.
    fine = [F.least(F.floor((F.col(f"s{i}") - low[i]) / extent * 2.0 ** deepest), F.lit(2 ** deepest - 1)).cast("long") for i in axes]
    placed = S.select("*", *[c.alias(f"f{i}") for i, c in enumerate(fine)])
    levels = placed.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(deepest), F.lit(step))))

    def cell(i, level):
        return F.expr(f"shiftright(f{i}, {deepest} - {level})")
    cells = levels.groupBy("sg", "level", *[cell(i, "level").alias(f"c{i}") for i in axes]).agg(
        F.count(F.lit(1)).alias("n"), *[f(f"s{i}").alias(f"{e}{i}") for i in axes for f, e in ((F.min, "lo"), (F.max, "hi"))])
    point = F.lit(True)
    for i in axes:
        point = point & (F.col(f"lo{i}") == F.col(f"hi{i}"))
    cells = cut_lineage(cells.withColumn("leaf", (F.col("n") <= LEAF) | (F.col("level") == deepest) | point))
    gap = F.sqrt(_total([F.pow(F.greatest(F.col(f"lo{i}") - F.col(f"b{i}"), F.col(f"a{i}") - F.col(f"hi{i}"), F.lit(0.0)), F.lit(2)) for i in axes]))
    reach = F.sqrt(_total([F.pow(F.greatest(F.col(f"b{i}") - F.col(f"lo{i}"), F.col(f"hi{i}") - F.col(f"a{i}")), F.lit(2)) for i in axes]))
    box, ids = [f"{e}{i}" for i in axes for e in "ab"], [f"c{i}" for i in axes]
    sums = Window.partitionBy("block").orderBy("reach").rangeBetween(Window.unboundedPreceding, Window.currentRow)

    def sure(cand: DataFrame) -> DataFrame:
        """Without the cells that are farther than the distance within which ``want`` rows surely are of each point."""
        c = cand.withColumn("_sum", F.sum("n").over(sums))
        c = c.withColumn("_r", F.min(F.when(F.col("_sum") >= want, F.col("reach"))).over(Window.partitionBy("block")))
        return c.filter(F.col("_r").isNull() | (F.col("gap") <= F.col("_r") * (1 + 1e-12))).drop("_sum", "_r")

    def walked(blocks: DataFrame) -> DataFrame:
        """(block, cell) of the leaves that can hold one of the nearest rows of a block's points."""
        top = cells.filter("level = 0").withColumnRenamed("sg", "cg")
        cand = blocks.join(top, blocks["pg"].eqNullSafe(top["cg"])).select("block", "pg", *box, "level", *ids, "n", "leaf", gap.alias("gap"), reach.alias("reach"))
        cand = cut_lineage(sure(cand))
        for level in range(0, deepest, step):
            inner = cand.filter(~F.col("leaf"))
            if inner.limit(1).count() == 0:
                break
            below = cells.filter(F.col("level") == level + step).select(
                F.col("sg").alias("cg"), "level", *ids, *[F.shiftright(f"c{i}", step).alias(f"u{i}") for i in axes], "n", "leaf", *[f"{e}{i}" for i in axes for e in ("lo", "hi")])
            at = inner.select("block", "pg", *box, *[F.col(c).alias(f"at{i}") for i, c in enumerate(ids)])
            cond = at["pg"].eqNullSafe(below["cg"])
            for i in axes:
                cond = cond & (at[f"at{i}"] == below[f"u{i}"])
            if 2 ** (dim * (level + step)) <= 4096 and not grouped:              # so many cells at most
                below = F.broadcast(below)
            down = at.join(below, cond).select("block", "pg", *box, "level", *ids, "n", "leaf", gap.alias("gap"), reach.alias("reach"))
            cand = cut_lineage(sure(cand.filter("leaf").unionByName(down)))
        return cand

    # As wide as a cell of LEAF rows, if rows lay evenly: wider blocks would face too many.
    asked = cut_lineage(_blocks(P, dim, extent / max(1.0, (b[0] / LEAF) ** (1 / dim))))
    boxes = asked.groupBy("block", "pg").agg(F.count(F.lit(1)).alias("_points"), *[f(f"p{i}").alias(f"{e}{i}") for i in axes for f, e in ((F.min, "a"), (F.max, "b"))])
    cand = walked(boxes)
    many = boxes.filter("_points > 1").join(cand.groupBy("block").agg(F.sum("n").alias("_faced")).filter(F.col("_faced") > FACED), "block", "left_semi").select("block")
    many = cut_lineage(many)
    if many.limit(1).count():
        single = asked.join(many, "block", "left_semi").withColumn("block", F.concat("block", F.lit("."), "_i"))
        single = cut_lineage(single)
        asked = asked.join(many, "block", "left_anti").unionByName(single)
        alone = single.select("block", "pg", *[F.col(f"p{i}").alias(f"{e}{i}") for i in axes for e in "ab"])
        cand = cand.join(many, "block", "left_anti").unionByName(walked(alone))
    # Row by row in the cells that are left.
    level_of = cells.filter("leaf").select("sg", "level", *ids)
    lv = level_of.select(F.col("sg").alias("lg"), F.col("level").alias("ll"), *[F.col(c).alias(f"l{i}") for i, c in enumerate(ids)])
    held = placed.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(deepest), F.lit(step)))).select(
        "sid", "sg", *[f"s{i}" for i in axes], "level", *[cell(i, "level").alias(f"h{i}") for i in axes])
    cond = held["sg"].eqNullSafe(lv["lg"]) & (held["level"] == lv["ll"])
    for i in axes:
        cond = cond & (held[f"h{i}"] == lv[f"l{i}"])
    held = held.join(lv, cond, "left_semi").withColumnRenamed("level", "hl")
    cond = cand["pg"].eqNullSafe(held["sg"]) & (cand["level"] == held["hl"])
    for i in axes:
        cond = cond & (cand[f"c{i}"] == held[f"h{i}"])
    faced = cand.join(held, cond).select(F.col("block").alias("by"), "sid", *[f"s{i}" for i in axes])
    run = _nearest_of_block(dim, k, exclude_self)
    kind = {f: d.schema[f].dataType.simpleString() for d, f in ((P, "pid"), (S, "sid"))}
    near = asked.select("block", "pid", *[f"p{i}" for i in axes]).groupBy("block").cogroup(faced.groupBy("by")).applyInArrow(
        run, f"pid {kind['pid']}, sid {kind['sid']}, _d double")
    best = Window.partitionBy("pid").orderBy("_d", "sid")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(*kinds.split(", "))


def _blocks(P: DataFrame, dim: int, widest: float) -> DataFrame:
    """P with ``block``: at most ``BLOCK`` points of one group that lie within ``widest``, and ``_i``, their numbers in it."""
    axes, bits = range(dim), min(20, 60 // dim)
    b = P.agg(*[f(f"p{i}") for f in (F.min, F.max) for i in axes]).first()
    low = [b[i] if b[i] is not None else 0.0 for i in axes]
    extent = max([b[dim + i] - low[i] for i in axes if b[i] is not None] + [1e-300])
    fine = P.select("*", *[F.least(F.floor((F.col(f"p{i}") - low[i]) / extent * 2.0 ** bits), F.lit(2 ** bits - 1)).cast("long").alias(f"_f{i}") for i in axes])
    # Places along a curve that keeps near ones together.
    curve = " + ".join(f"shiftleft(shiftright(_f{i}, {x}) & 1, {x * dim + i})" for x in range(bits) for i in axes)
    rows = fine.withColumn("_z", F.expr(curve)).withColumn("_h", F.xxhash64("pid")).drop(*[f"_f{i}" for i in axes])
    rows = rows.repartitionByRange("pg", "_z", "_h").sortWithinPartitions("pg", "_z", "_h").withColumn("_part", F.spark_partition_id()).drop("_z", "_h")
    names = [c for c in rows.columns if c != "_part"]

    def run(batches):
        count = 0
        for batch in batches:
            x = np.stack([batch.column(f"p{i}").to_numpy(zero_copy_only=False) for i in axes], axis=1)
            group = batch.column("pg").to_pylist()                  # of any type
            block, inside = np.empty(batch.num_rows, dtype=np.int64), np.empty(batch.num_rows, dtype=np.int64)
            cuts = [i for i in range(1, len(group)) if group[i] != group[i - 1]]
            todo = [p for p in np.split(np.arange(batch.num_rows), cuts) if len(p)]
            while todo:
                at = todo.pop()
                lo, hi = x[at].min(axis=0), x[at].max(axis=0)
                axis = int((hi - lo).argmax())
                side = x[at, axis] <= lo[axis] + (hi[axis] - lo[axis]) / 2
                if (len(at) > BLOCK or hi[axis] - lo[axis] > widest) and side.any() and not side.all():
                    todo += [at[side], at[~side]]
                    continue
                for a in range(0, len(at), BLOCK):
                    own = at[a:a + BLOCK]
                    block[own], inside[own] = count, np.arange(len(own))
                    count += 1
            part = batch.column("_part")[0].as_py() if batch.num_rows else 0
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([f"{part}:{n}" for n in block.tolist()], pa.string()), pa.array(inside.astype(str).tolist(), pa.string())],
                                             names=[*names, "block", "_i"])

    return rows.mapInArrow(run, P.select(*names).schema.add("block", "string").add("_i", "string"))


def _nearest_of_block(dim: int, k: int, exclude_self: bool):
    """The ``k`` nearest rows of each point of a block, ties by sid."""
    def run(points: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows["sid"], null_placement="at_start"))
        p, s = (np.stack([t[f"{c}{i}"].to_numpy() for i in range(dim)], axis=1) for t, c in ((points, "p"), (rows, "s")))
        own, found, far = [], [], []
        if exclude_self:
            both = pa.chunked_array([*points["pid"].chunks, *rows["sid"].cast(points.schema.field("pid").type).chunks], type=points.schema.field("pid").type)
            code = pc.rank(both, null_placement="at_start", tiebreaker="dense").to_numpy()
        chunk = max(1, (1 << 20) // max(len(s), 1))
        for a in range(0, len(p) if len(s) else 0, chunk):
            d = np.zeros((len(p[a:a + chunk]), len(s)))
            for i in range(dim):
                d += (p[a:a + chunk, i, None] - s[None, :, i]) ** 2
            d = np.sqrt(d)
            other = np.ones(d.shape, dtype=bool)
            if exclude_self:
                other = code[a:a + chunk][:len(d), None] != code[None, len(p):]
                d = np.where(other, d, np.inf)
            near = np.argsort(d, axis=1, kind="stable")[:, :k + exclude_self]
            at = np.arange(len(d))[:, None]
            kept = other[at, near]
            own.append(np.broadcast_to(a + at, near.shape)[kept])
            found.append(near[kept])
            far.append(d[at, near][kept])
        own, found, far = (np.concatenate(v) if v else np.zeros(0, t) for v, t in ((own, np.int64), (found, np.int64), (far, float)))
        return pa.table([points["pid"].take(pa.array(own)), rows["sid"].take(pa.array(found)), pa.array(far)], names=["pid", "sid", "_d"])

    return run


def _nearest_by_point(points: DataFrame, refs: DataFrame, dim: int, k: int, exclude_self: bool = False) -> DataFrame:
    """``nearest`` for ids or groups that are structs: every point walks alone."""
    grouped = "sg" in refs.columns
    P, S = (d if grouped else d.withColumn(g, F.lit(0)) for d, g in ((points, "pg"), (refs, "sg")))
    want = k + exclude_self
    axes = range(dim)
    same_place = Window.partitionBy("sg", *[f"s{i}" for i in axes]).orderBy("sid")
    S = cut_lineage(S.withColumn("_n", F.row_number().over(same_place)).filter(F.col("_n") <= want).drop("_n"))
    b = S.agg(F.count(F.lit(1)), *[f(f"s{i}") for f in (F.min, F.max) for i in axes]).first()
    kinds = "pid, sid, rank, _d"
    if not b[0]:
        return points.limit(0).select("pid", F.col("pid").alias("sid"), F.lit(0).alias("rank"), F.lit(0.0).alias("_d"))
    low = [b[1 + i] for i in axes]
    extent = max([b[1 + dim + i] - low[i] for i in axes] + [1e-300])
    step = 2 if dim <= 3 else 1
    deepest = step * math.ceil((math.log2(b[0] + 1) / dim + 6) / step)
    # Every level's cells in one pass: counts and boxes.
    fine = [F.least(F.floor((F.col(f"s{i}") - low[i]) / extent * 2.0 ** deepest), F.lit(2 ** deepest - 1)).cast("long") for i in axes]
    placed = S.select("*", *[c.alias(f"f{i}") for i, c in enumerate(fine)])
    levels = placed.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(deepest), F.lit(step))))

    def cell(i, level):
        return F.expr(f"shiftright(f{i}, {deepest} - {level})")
    cells = levels.groupBy("sg", "level", *[cell(i, "level").alias(f"c{i}") for i in axes]).agg(
        F.count(F.lit(1)).alias("n"), *[f(f"s{i}").alias(f"{e}{i}") for i in axes for f, e in ((F.min, "lo"), (F.max, "hi"))])
    point = F.lit(True)
    for i in axes:
        point = point & (F.col(f"lo{i}") == F.col(f"hi{i}"))
    cells = cut_lineage(cells.withColumn("leaf", (F.col("n") <= LEAF) | (F.col("level") == deepest) | point))
    gap = F.sqrt(_total([F.pow(F.greatest(F.col(f"lo{i}") - F.col(f"p{i}"), F.col(f"p{i}") - F.col(f"hi{i}"), F.lit(0.0)), F.lit(2)) for i in axes]))
    reach = F.sqrt(_total([F.pow(F.greatest(F.abs(F.col(f"p{i}") - F.col(f"lo{i}")), F.abs(F.col(f"p{i}") - F.col(f"hi{i}"))), F.lit(2)) for i in axes]))
    coords, ids = [f"p{i}" for i in axes], [f"c{i}" for i in axes]
    sums = Window.partitionBy("pid").orderBy("reach").rangeBetween(Window.unboundedPreceding, Window.currentRow)

    def sure(cand: DataFrame) -> DataFrame:
        """Without the cells that are farther than the distance within which ``want`` rows surely are."""
        c = cand.withColumn("_sum", F.sum("n").over(sums))
        c = c.withColumn("_r", F.min(F.when(F.col("_sum") >= want, F.col("reach"))).over(Window.partitionBy("pid")))
        return c.filter(F.col("_r").isNull() | (F.col("gap") <= F.col("_r") * (1 + 1e-12))).drop("_sum", "_r")

    top = cells.filter("level = 0").withColumnRenamed("sg", "cg")
    cand = P.join(top, P["pg"].eqNullSafe(top["cg"])).select("pid", "pg", *coords, "level", *ids, "n", "leaf", gap.alias("gap"), reach.alias("reach"))
    cand = cut_lineage(sure(cand))
    for level in range(0, deepest, step):
        inner = cand.filter(~F.col("leaf"))
        if inner.limit(1).count() == 0:
            break
        below = cells.filter(F.col("level") == level + step).select(
            F.col("sg").alias("cg"), "level", *ids, *[F.shiftright(f"c{i}", step).alias(f"u{i}") for i in axes], "n", "leaf", *[f"{e}{i}" for i in axes for e in ("lo", "hi")])
        at = inner.select("pid", "pg", *coords, *[F.col(c).alias(f"at{i}") for i, c in enumerate(ids)])
        cond = at["pg"].eqNullSafe(below["cg"])
        for i in axes:
            cond = cond & (at[f"at{i}"] == below[f"u{i}"])
        if 2 ** (dim * (level + step)) <= 4096 and not grouped:              # so many cells at most
            below = F.broadcast(below)
        down = at.join(below, cond).select("pid", "pg", *coords, "level", *ids, "n", "leaf", gap.alias("gap"), reach.alias("reach"))
        cand = cut_lineage(sure(cand.filter("leaf").unionByName(down)))
    # Row by row in the cells that are left.
    level_of = cells.filter("leaf").select("sg", "level", *ids)
    lv = level_of.select(F.col("sg").alias("lg"), F.col("level").alias("ll"), *[F.col(c).alias(f"l{i}") for i, c in enumerate(ids)])
    held = placed.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(deepest), F.lit(step)))).select(
        "sid", "sg", *[f"s{i}" for i in axes], "level", *[cell(i, "level").alias(f"h{i}") for i in axes])
    cond = held["sg"].eqNullSafe(lv["lg"]) & (held["level"] == lv["ll"])
    for i in axes:
        cond = cond & (held[f"h{i}"] == lv[f"l{i}"])
    held = held.join(lv, cond, "left_semi").withColumnRenamed("level", "hl")
    cond = cand["pg"].eqNullSafe(held["sg"]) & (cand["level"] == held["hl"])
    for i in axes:
        cond = cond & (cand[f"c{i}"] == held[f"h{i}"])
    j = cand.join(held, cond)
    if exclude_self:
        j = j.filter(~F.col("pid").eqNullSafe(F.col("sid")))
    j = j.select("pid", "sid", F.sqrt(_total([F.pow(F.col(f"p{i}") - F.col(f"s{i}"), F.lit(2)) for i in axes])).alias("_d"))
    best = Window.partitionBy("pid").orderBy("_d", "sid")
    return j.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(*kinds.split(", "))


# --- many dimensions ------------------------------------------------------------------------
FAN = 4


def _projections(x: DataFrame, directions: np.ndarray) -> DataFrame:
    """id, v and ``q``: the projections of v on each direction."""
    def run(batches):
        for b in batches:
            v = np.asarray(b.column("v").flatten(), dtype=float).reshape(b.num_rows, -1)
            q = v @ directions.T
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.ListArray.from_arrays(
                pa.array(np.arange(b.num_rows + 1) * q.shape[1], pa.int32()), pa.array(q.ravel()))], names=["id", "v", "q"])

    return x.mapInArrow(run, f"id {x.schema['id'].dataType.simpleString()}, v array<double>, q array<double>")


def _leaf_pairs(kind: str, k: int):
    """The ``k`` nearest of each row of a leaf, compared in blocks of rows."""
    def run(t: pa.Table) -> pa.Table:
        n = t.num_rows
        v = np.asarray(t["v"].combine_chunks().flatten(), dtype=float).reshape(n, -1)
        ids, square = t["id"].combine_chunks(), (v * v).sum(axis=1)
        left, right, dist = [], [], []
        take = min(k, n - 1)
        for a in range(0, n, 512):
            if take < 1:
                break
            d = square[a:a + 512, None] + square[None] - 2 * v[a:a + 512] @ v.T
            rows = np.arange(len(d))
            d[rows, a + rows] = np.inf
            near = np.argpartition(d, take - 1, axis=1)[:, :take]
            exact = np.sqrt(((v[a:a + 512, None] - v[near]) ** 2).sum(axis=2))
            left.append(np.repeat(a + rows, take))
            right.append(near.ravel())
            dist.append(exact.ravel())
        left, right = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        return pa.table([ids.take(pa.array(left)), ids.take(pa.array(right)), pa.array(np.concatenate(dist) if dist else np.zeros(0))], names=["id", "neighbour", "distance"])

    return run, f"id {kind}, neighbour {kind}, distance double"


def forest_neighbours(df: DataFrame, key: str, features: Sequence[str], k: int = 5, trees: int = 12, leaf: int = 256, seed: int = 42) -> DataFrame:
    """(key, neighbour, rank, distance): about the ``k`` nearest other rows of each row over all ``features``.

    ``key`` is unique, features are numbers without NULL.  Up to ``leaf`` rows the result is exact.  Rows equal on a
    cut are dealt to its sides by a hash, so many equal rows don't make a large leaf.
    """
    x = cut_lineage(df.select(F.col(key).alias("id"), F.array(*[F.col(c).cast("double") for c in features]).alias("v")))
    depth = max(0, math.ceil(math.log(max(x.count(), 1) / leaf, FAN)))
    trees = trees if depth else 1
    rng = np.random.default_rng(seed)
    directions = rng.normal(size=(trees * max(depth, 1), len(features)))
    rows = _projections(x, directions).select("*", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).withColumn("node", F.lit(0).cast("long"))
    for level in range(depth):
        rows = cut_lineage(rows.withColumn("_q", F.col("q")[F.col("tree") * depth + level]))
        cuts = rows.groupBy("tree", "node").agg(F.percentile_approx("_q", [i / FAN for i in range(1, FAN)], 1000).alias("cuts"))
        j = rows.join(cuts, ["tree", "node"])
        below = F.size(F.filter("cuts", lambda c: c < F.col("_q")))
        on = F.size(F.filter("cuts", lambda c: c == F.col("_q")))
        side = below + F.when(on > 0, F.pmod(F.xxhash64("id", "tree", F.lit(level)), on + 1)).otherwise(0)
        rows = j.withColumn("node", F.col("node") * FAN + side).drop("cuts", "_q")
    run, schema = _leaf_pairs(x.schema["id"].dataType.simpleString(), k)
    pairs = rows.select("id", "v", "tree", "node").groupBy("tree", "node").applyInArrow(run, schema)
    best = Window.partitionBy("id").orderBy("distance", "neighbour")
    one = pairs.groupBy("id", "neighbour").agg(F.min("distance").alias("distance"))
    return one.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(F.col("id").alias(key), "neighbour", "rank", "distance")


def measured_recall(df: DataFrame, found: DataFrame, key: str, features: Sequence[str], k: int = 5, sample: int = 200, seed: int = 1) -> float:
    """Share of the true ``k`` nearest rows that ``found`` holds, over at most ``sample`` rows compared with all rows."""
    ids = [r[0] for r in df.select(key).orderBy(F.xxhash64(F.lit(seed), F.col(key))).limit(sample).collect()]
    x = df.select(F.col(key).alias("id"), F.array(*[F.col(c).cast("double") for c in features]).alias("v"))
    asked = x.filter(F.col("id").isin(ids)).toPandas()
    q = np.array(asked["v"].tolist(), dtype=float)

    def run(batches):
        for b in batches:
            v = np.asarray(b.column("v").flatten(), dtype=float).reshape(b.num_rows, -1)
            own = b.column("id").to_pylist()
            rows = []
            for i, (mine, vec) in enumerate(zip(asked["id"], q)):
                d = np.sqrt(((v - vec) ** 2).sum(axis=1))
                for n in np.argsort(d, kind="stable")[:k + 1]:
                    if own[n] != mine:
                        rows.append((i, float(d[n])))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64())], names=["i", "d"])

    w = Window.partitionBy("i").orderBy("d")
    true = x.mapInArrow(run, "i long, d double").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k)
    limit = {r["i"]: (r["far"], r["n"]) for r in true.groupBy("i").agg(F.max("d").alias("far"), F.count(F.lit(1)).alias("n")).collect()}
    place = {v: i for i, v in enumerate(asked["id"])}
    hits = sum(r["distance"] <= limit[place[r[key]]][0] * (1 + 1e-9) + 1e-12 for r in found.filter(F.col(key).isin(ids)).select(key, "distance").collect())
    return hits / max(sum(n for _, n in limit.values()), 1)
