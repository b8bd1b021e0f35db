"""Operators over feature tables."""
