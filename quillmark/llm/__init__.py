"""Operators of a training-data pipeline (optional part of the package)."""
