"""Collects the registered queries of every section."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .catalog import ENTRIES, Tables, present

_SECTIONS = (
    "history", "metric", "decision", "feature", "quality", "join", "source", "statistics",
    "model", "stream",
)


def _load() -> None:
    for section in _SECTIONS:
        importlib.import_module(f"{__package__}.{section}_queries")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def runner(build):
        return lambda spark, sf_dir: present(build(Tables(spark, sf_dir)))

    return {name: runner(entry.build) for name, entry in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: e.oracle for name, e in ENTRIES.items() if e.oracle is not None}


def coverage() -> dict[str, list[str]]:
    """Inventory id to the query names that cover it."""
    _load()
    found: dict[str, list[str]] = {}
    for name, entry in ENTRIES.items():
        for survey_id in entry.survey.split():
            found.setdefault(survey_id, []).append(name)
    return found
