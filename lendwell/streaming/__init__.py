"""Structured Streaming forms of on-demand scoring and the daily report."""
