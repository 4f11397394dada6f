"""Where queries register: a name, a function of (spark, sf_dir), and SQL over the scene's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridweave.sources import scene

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name; sql may use the scene's tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            recursive = "RECURSIVE " if "UNION ALL" in sql and "RECURSION" in sql else ""
            SQL[f.__name__] = f"WITH {recursive}{scene.SCENE_SQL}{sql}".replace("/*RECURSION*/", "")
        return f

    return add
