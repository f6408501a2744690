"""Operators of a training-data pipeline; see the table in the README."""
