"""All registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.plans import browsing, curation, moderating, publishing, records, resolution, texts

FAMILIES = (browsing, texts, records, resolution, curation, publishing, moderating)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for f in FAMILIES for k, (q, _) in f.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for f in FAMILIES for k, (_, s) in f.QUERIES.items() if s}
