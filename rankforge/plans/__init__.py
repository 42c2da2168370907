"""Registered queries over the given tables, each with the SQL it must agree with where there is one."""

from . import exploration, feature_sets, models, preparation, ranking, scoring, search  # noqa: F401
from .registry import REGISTRY, Query

__all__ = ["REGISTRY", "Query"]
