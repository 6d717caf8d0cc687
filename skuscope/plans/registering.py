"""The registry of queries and their oracles, and rounding that engines agree on."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .market import BASE_SQL, SIGNAL_SQL, Market

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, base: int = 0):
    """Registers a builder of (Market) -> DataFrame; base 1 or 2 puts the market (and signal) tables before the SQL."""

    def add(build):
        QUERIES[build.__name__] = lambda spark, sf_dir: build(Market(spark, sf_dir))
        if sql is not None:
            head = "" if not base else "WITH " + BASE_SQL + ("" if base == 1 else "," + SIGNAL_SQL)
            ORACLES[build.__name__] = head + off_half(sql)
        return build

    return add


def r(c: str, digits: int = 4, name: str | None = None):
    """Rounded off the half-way points, where engines differ by the last bit."""
    scale = 10.0**digits
    return (F.floor(F.col(c).cast("double") * scale + 0.37) / scale).alias(name or c)


def off_half(sql: str) -> str:
    """round(x, n) of an oracle in the same terms."""
    return re.sub(r"(?<![a-z_])round\(((?:[^()]|\([^()]*\))*), (\d)\)", r"(floor((\1) * 1e\2 + 0.37) / 1e\2)", sql)


def n(c: str, name: str | None = None):
    return F.col(c).cast("bigint").alias(name or c)


def whole(c: str, name: str | None = None):
    """The nearest whole number, ties upwards: ``floor(x + 0.5)`` of an oracle, where Spark's round takes ties away from zero."""
    return F.floor(F.col(c) + 0.5).cast("double").alias(name or c)
