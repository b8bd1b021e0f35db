"""Whole flows of operators: from a feature table to a final one, and from a final one to a report."""
