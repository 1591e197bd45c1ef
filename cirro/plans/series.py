"""Series specification and the window builder used by every operator.

A series table has key columns (``keys``), a timestamp (``order``) and
optionally extra tie-break columns that make the order total.  Window
operators never call ``Window.partitionBy(keys)`` directly: they ask a
``SeriesWindow`` for their frames.  The window object is bound to a
layout (see ``cirro.plans.layout``): rows carry a 1-based position
``_pos`` inside their series and a block id ``_blk``; the partition is
``keys + [_blk]`` and the order is ``_pos``.  Every frame therefore has
one partition/order spec, so Catalyst collapses all window expressions
of one ``select`` into a single Window node with one exchange and one
sort.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

POS = "_pos"
BLK = "_blk"
CORE = "_core"


@dataclass(frozen=True)
class SeriesSpec:
    keys: tuple[str, ...] = ("series_id",)
    order: str = "ts"
    tiebreak: tuple[str, ...] = field(default_factory=tuple)
    # Rows per block of the blocked layout.  A series longer than this is
    # split over several tasks with halos; shorter series are one block.
    block_rows: int = 2_000_000
    # Width of the time buckets used to number rows (seconds of wall clock).
    bucket_seconds: int = 86_400

    @property
    def order_cols(self) -> list[str]:
        return [self.order, *self.tiebreak]


class SeriesWindow:
    """Frames over the blocked layout of one series table."""

    def __init__(self, spec: SeriesSpec):
        self.spec = spec
        self.w = Window.partitionBy(*spec.keys, BLK).orderBy(POS)

    def rows(self, start: int, end: int):
        return self.w.rowsBetween(start, end)

    def trailing(self, n: int):
        """pandas ``rolling(n)``: the current row and n-1 before it."""
        return self.w.rowsBetween(-(n - 1), 0)

    def running(self):
        """From the first row of the block to the current row."""
        return self.w.rowsBetween(Window.unboundedPreceding, 0)

    def ahead(self, n: int):
        """The n rows after the current one."""
        return self.w.rowsBetween(1, n)

    def lag(self, c: str | Column, n: int) -> Column:
        return F.lag(c, n).over(self.w)

    def lead(self, c: str | Column, n: int) -> Column:
        return F.lead(c, n).over(self.w)
