"""Operators of a training-data pipeline: filtering, dedup, extraction, mixing, token output."""
