"""Scalar functions and the JSON query language."""
