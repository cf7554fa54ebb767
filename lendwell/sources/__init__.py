"""Readers and writers for the lending tables, models and JSON artifacts."""
