"""The registered queries: one per SURVEY section-2 operator, each with its
DuckDB oracle SQL where the result is SQL-expressible."""

from hearth.catalog import q_data, q_eval, q_features, q_models, q_nulls, q_proofs  # noqa: F401  (registers queries)
from hearth.catalog.registry import REGISTRY, Entry

__all__ = ["REGISTRY", "Entry"]
