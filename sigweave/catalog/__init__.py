"""Named queries over the provided tables, each with SQL of the same meaning."""

from __future__ import annotations

from . import entities, evaluation, exchange, labelling, ranking, resampling, studies  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
