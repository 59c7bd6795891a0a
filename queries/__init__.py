"""Registered queries: each name has a Spark function and, where SQL can say it, the same result in DuckDB SQL."""

from queries import corpus, features, models, sampling, sources, steps, texts  # noqa: F401
from queries.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
