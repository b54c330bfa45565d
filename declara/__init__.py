"""Incident-declaration analytics as PySpark jobs: DataFrames in, DataFrames out."""
