"""Operators: plain functions from DataFrame to DataFrame. Patterns stay long, one row per point."""
