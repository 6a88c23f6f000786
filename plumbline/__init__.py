"""Leakage-safe tabular analytics on Spark."""
