"""How a query is registered: a function of a Fixture, and SQL over the projection FX."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetline.plans.fixtures import FX, Fixture

#: places to which doubles are rounded on both sides; operators round mean lateness alone, to tenths of a second
PLACES = 6
_QUERIES: dict[str, tuple[Callable[[Fixture], DataFrame], str | None, tuple[str, ...]]] = {}


def query(name: str, sql: str | None = None, doubles: str = "") -> Callable:
    """Register ``fn(fx)``.  ``sql`` may begin with ", name AS (...)" to add to FX."""

    def add(fn: Callable[[Fixture], DataFrame]) -> Callable:
        _QUERIES[name] = (fn, sql, tuple(doubles.split()))
        return fn

    return add


def _run(fn: Callable[[Fixture], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fn(Fixture(spark, sf_dir))
        return df.select(*[F.round(F.col(c), PLACES).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _run(fn) for name, (fn, _, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (_, sql, doubles) in _QUERIES.items():
        if sql:
            whole = f"WITH {FX}{sql}"
            rounded = ", ".join(f"round({c}, {PLACES}) AS {c}" for c in doubles)
            out[name] = f"SELECT * REPLACE ({rounded}) FROM ({whole}) x" if doubles else whole
    return out
