"""Registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.base import Inputs, with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(inputs) -> DataFrame`` under ``name``, with its SQL if it has one."""

    def register(fn: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: fn(Inputs.of(spark, folder))
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return fn

    return register


# Results of the two engines differ in the last bits where sums run in another order. Numbers
# are put on a decimal grid whose cell borders (.5003) are no round decimals, so that exact
# halves do not fall on either side.


def grid(c: str | Column, digits: int = 4) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    scale = F.lit(float(10**digits))
    x = c.cast("double") * scale + F.lit(0.5003)
    # floor goes through a long; from 2^52 on a double is whole, or infinite, or no number
    return F.when(F.abs(x) < F.lit(2.0**52), F.floor(x).cast("double")).otherwise(x) / scale


def g(expression: str, digits: int = 4) -> str:
    """The same grid as SQL text."""
    return f"(floor((({expression})::DOUBLE) * 1e{digits}::DOUBLE + 0.5003::DOUBLE) / 1e{digits}::DOUBLE)"


def gs(names: str, digits: int = 4) -> str:
    """``g`` for a list of plain columns, each keeping its name."""
    return ", ".join(f"{g(n, digits)} AS {n}" for n in names.split())


def gridded(df: DataFrame, keys: str, numbers: str, digits: int = 4) -> DataFrame:
    return df.select(*keys.split(), *[grid(n, digits).alias(n) for n in numbers.split()])
