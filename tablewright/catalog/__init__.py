"""All registered queries; importing the package fills the registry."""

from tablewright.catalog import clean_queries, evaluate_queries, model_queries, prepare_queries, profile_queries  # noqa: F401
from tablewright.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
