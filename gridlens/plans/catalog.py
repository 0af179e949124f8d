"""All registered queries (importing the query modules fills the registry)."""

from __future__ import annotations

from . import q_dashboard, q_ingest, q_integrity, q_models, q_reports, q_series, q_streams, q_tariff  # noqa: F401
from .registry import REGISTRY, QuerySpec


def load() -> dict[str, QuerySpec]:
    return REGISTRY


def queries() -> dict:
    return {k: v.build for k, v in load().items()}


def oracle_sql() -> dict:
    return {k: v.sql for k, v in load().items() if v.sql}
