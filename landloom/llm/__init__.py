"""Operators of a training-data pipeline; self-contained, nothing else in the library imports it."""
