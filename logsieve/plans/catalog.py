"""Registered queries over the driver's tables, each with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logsieve.plans import cases, lines, machines, tables, upkeep, verdicts, wire

_MODULES = (lines, verdicts, tables, cases, machines, upkeep, wire)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
