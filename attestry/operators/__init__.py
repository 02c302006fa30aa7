"""Operators on evidence, runs and provenance."""
