"""Operators for large training-data pipelines: extraction, filters, joins, scoring, mixing, tokens."""
