"""All registered queries of the engine's own operators."""

from . import analytics, frames, models, scalars, tpch, verbs  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
