"""Query registry: key -> (Spark builder, oracle SQL or None)."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

# Fixed parameters of the registered queries ("now" of the fixtures: the day
# after the last event).
AS_OF = "2024-01-31 00:00:00"


@dataclass(frozen=True)
class QuerySpec:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    group: str


REGISTRY: dict[str, QuerySpec] = {}


def register(name: str, sql: str | None, group: str):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")

        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            from ..session import prepare_session
            return fn(prepare_session(spark), sf_dir)

        build.__name__ = getattr(fn, "__name__", name)
        build.__doc__ = fn.__doc__
        REGISTRY[name] = QuerySpec(name, build, sql, group)
        return fn
    return deco
