"""Registry of named queries: a Spark plan and, where SQL can say it, its check query."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from delaylens.sources.tables import Tables


@dataclass(frozen=True)
class Query:
    name: str
    plan: Callable[[Tables], DataFrame]
    sql: str | None
    ready: bool = False


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None, ready: bool = False):
    """Register a plan; one that is ``ready`` has given its columns the common types itself."""

    def register(plan: Callable[[Tables], DataFrame]):
        if plan.__name__ in REGISTRY:
            raise ValueError(f"duplicate query {plan.__name__}")
        REGISTRY[plan.__name__] = Query(plan.__name__, plan, sql, ready)
        return plan

    return register


def tidy(df: DataFrame) -> DataFrame:
    """Common result types: bigint, double rounded to 6 digits, string."""
    out = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.BooleanType)):
            col = col.cast("bigint")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            col = F.round(col.cast("double"), 6)
        elif isinstance(f.dataType, T.DateType):
            col = F.date_format(col, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        out.append(col.alias(f.name))
    return df.select(*out)


def half_up(df: DataFrame, *names: str) -> DataFrame:
    """Round in decimal: for means of short decimals, which often end in an exact half."""
    return df.withColumns({n: F.round(F.col(n).cast("decimal(28,12)"), 6).cast("double") for n in names})


def run(name: str, tables: Tables) -> DataFrame:
    found = REGISTRY[name]
    return found.plan(tables) if found.ready else tidy(found.plan(tables))
