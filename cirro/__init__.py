"""cirro: series analytics and event forecasting as Spark DataFrame jobs.

Every operator takes and returns a DataFrame (or returns Columns to be
placed in one ``select``).  Series are identified by key columns and
ordered by a timestamp plus an optional tie-break; window work runs on a
position-blocked layout (``cirro.plans.layout``) so that one very large
series is still split over many tasks.
"""

from cirro.plans.series import SeriesSpec

__all__ = ["SeriesSpec"]
