"""Operators of a large training-data pipeline, each over whole tables."""
