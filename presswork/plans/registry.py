"""All queries of the library by name, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from presswork.sources import fixtures

MODULES = (*(f"operators.{m}" for m in ("reports", "quality", "dedupe", "history", "extraction", "main_text", "frontier", "reputation", "maintenance", "snapshots", "constraints")), "streaming.queries")


def _all() -> dict[str, tuple[Callable[[fixtures.Tables], DataFrame], str | None]]:
    out: dict = {}
    for m in MODULES:
        out |= import_module(f"presswork.{m}").QUERIES
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: (lambda spark, sf_dir, make=make: make(fixtures.Tables(spark, sf_dir))) for n, (make, _) in _all().items()}


def oracles() -> dict[str, str]:
    return {n: fixtures.with_tables(sql) for n, (_, sql) in _all().items() if sql}
