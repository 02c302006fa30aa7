"""Attestry: provenance and training-data analytics on PySpark."""
