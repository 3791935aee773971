"""Labelled web-risk datasets as Spark jobs."""

__version__ = "0.1.0"
