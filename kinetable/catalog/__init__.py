"""Registered queries: each one a Spark function with, where SQL can say it, a DuckDB twin."""
