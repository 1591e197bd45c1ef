"""Registry of driver queries: name -> (Spark builder, oracle SQL).

Builders take ``(spark, sf_dir)`` and return a DataFrame.  Every DOUBLE
output column is rounded to 6 digits (after adding 1e-9 so decimal ties
round the same way in both engines); the oracle SQL does the same for the
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from cirro.functions.stats import round_doubles


@dataclass
class Entry:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    digits: dict = field(default_factory=dict)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_doubles(self.build(spark, sf_dir), 6, self.digits)


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None, digits: dict | None = None):
    def deco(fn):
        REGISTRY[name] = Entry(name, fn, sql, digits or {})
        return fn
    return deco


def R(expr: str, name: str, digits: int = 6) -> str:
    """Oracle-side rounding of one DOUBLE output column."""
    return f"round(CAST(({expr}) AS DOUBLE) + 1e-9, {digits}) AS {name}"


def rounded(inner: str, keep: list[str], doubles: list[str], digits: dict | None = None) -> str:
    """Wrap ``inner`` and round the listed DOUBLE columns."""
    digits = digits or {}
    cols = [f'"{c}"' for c in keep] + [R(f'"{c}"', f'"{c}"', digits.get(c, 6)) for c in doubles]
    return f"SELECT {', '.join(cols)} FROM ({inner}) AS _q"


QUERY_MODULES = ["q_windows", "q_filters", "q_aggregates", "q_exports", "q_sources",
                 "q_joins", "q_metrics", "q_grades", "q_spectral", "q_prep", "q_models"]


def load_all() -> dict[str, Entry]:
    """Import the query modules (which fills REGISTRY) and return it."""
    import importlib
    import importlib.util
    for m in QUERY_MODULES:
        name = f"cirro.plans.{m}"
        if importlib.util.find_spec(name) is not None:
            importlib.import_module(name)
    return REGISTRY
