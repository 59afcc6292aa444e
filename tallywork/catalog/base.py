"""Registration of queries and the small helpers both sides share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..bindings import Tables, cte

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def present(df: DataFrame) -> DataFrame:
    """Result columns in types every client compares alike: doubles and ISO text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None, tables: str = ""):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its check SQL."""
    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: present(fn(Tables(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = cte(sql.strip(), *tables.split())
        return fn
    return wrap


# --- exact rounding on the check side (integer arithmetic) -------------------

def half_up(num: str, den: str, dp: int) -> str:
    """num/den rounded half away from zero to ``dp`` places; null when den is 0."""
    s = 10 ** dp
    n, d = f"CAST({num} AS HUGEINT)", f"CAST({den} AS HUGEINT)"
    mag = f"((2 * {s} * abs({n}) + {d}) // (2 * {d}))"
    return f"CASE WHEN {d} <> 0 THEN CAST(sign({n}) * {mag} AS DOUBLE) / {s} END"


def half_even(num: str, den: str, dp: int) -> str:
    """num/den rounded half to even to ``dp`` places, for den > 0."""
    s = 10 ** dp
    v, d = f"CAST({num} AS HUGEINT)", f"CAST({den} AS HUGEINT)"
    n = f"(abs({v}) * {s})"
    q, r = f"({n} // {d})", f"({n} % {d})"
    up = f"(CASE WHEN 2 * {r} > {d} OR (2 * {r} = {d} AND {q} % 2 = 1) THEN 1 ELSE 0 END)"
    return f"CASE WHEN {d} <> 0 THEN CAST(sign({v}) * ({q} + {up}) AS DOUBLE) / {s} END"


def day(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


def stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


def num(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def cents(x: str) -> str:
    """Decimal(, 2,2) expression as whole cents."""
    return f"CAST({x} * 100 AS BIGINT)"
