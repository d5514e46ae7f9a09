"""Operators of a training-data pipeline: de-duplication, scoring, mixing, tokens and search."""
