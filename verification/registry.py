"""Name -> (Spark builder, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]
ENTRIES: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, build: Builder, sql: str | None = None) -> None:
    if name in ENTRIES:
        raise ValueError(f"registered twice: {name}")
    ENTRIES[name] = (build, sql)


def load_all() -> dict[str, tuple[Builder, str | None]]:
    from . import (  # noqa: F401  (each module registers its queries)
        q_charts,
        q_courses,
        q_dashboards,
        q_ingest,
        q_models,
        q_readiness,
        q_streams,
        q_students,
        q_texts,
    )

    return ENTRIES
