"""All registered queries of the retrieval engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from . import index, ingest, library, logs, retrieval, runs, streams  # noqa: F401
from .shared import ORACLE, QUERIES

FLAGSHIP = "d3_bm25_topk"


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
