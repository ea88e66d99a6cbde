"""DataFrame -> DataFrame operators, grouped by SURVEY section 2 category."""

from hearth.operators import encode, joins, metrics, profile, ranking, sampling, schema

__all__ = ["encode", "joins", "metrics", "profile", "ranking", "sampling", "schema"]
