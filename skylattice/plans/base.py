"""Registration helpers of the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.registry import query
from skylattice.sources import domain
from skylattice.sources.domain import with_tables

PLACES = 4


def r(x: Column, places: int = PLACES) -> Column:
    """A double that compares equal across engines."""
    return F.round(x, places)


def scalars(name: str, table: str, key: str, columns: Callable[[], dict[str, Column]], sql: dict[str, str], exact: str = "", where: str = "", places: int = PLACES) -> None:
    """Registers a projection of ``table``: ``key`` and ``columns``, doubles to ``places`` but for those in ``exact``."""
    plain = exact.split()
    shown = ", ".join(f"{v} AS {k}" if k in plain else f"round({v}, {places}) AS {k}" for k, v in sql.items())
    statement = with_tables(table, f"SELECT {key}, {shown} FROM {table}" + (f" WHERE {where}" if where else ""))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = getattr(domain, table)(spark, sf_dir)
        df = df.where(where) if where else df
        return df.select(key, *[(c if k in plain else r(c, places)).alias(k) for k, c in columns().items()])

    query(name, statement)(run)
