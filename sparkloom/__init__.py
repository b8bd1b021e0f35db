"""Spark jobs for mass-spectrometry feature tables, and for training data."""
