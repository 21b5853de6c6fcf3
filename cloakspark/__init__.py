"""Sensitive-data analytics on Spark DataFrames: detect, transform, tokenize, audit and report."""

__version__ = "0.1.0"
