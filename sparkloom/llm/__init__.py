"""Training-data operators: quality, toxicity, de-duplication, decontamination, archives, tokens, shards.

Nothing else in the library imports this subpackage.
"""
