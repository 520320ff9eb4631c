"""Training-data operators: filtering, deduplication, scoring, mixing and tokenised output.

Nothing outside this subpackage imports it.
"""
