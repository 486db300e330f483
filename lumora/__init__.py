"""Lumora: analytics over work-session records, written for PySpark."""
