"""Distributed building blocks: skew-safe joins, ordered runs, checks, metrics."""
