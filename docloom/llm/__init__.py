"""Training-data operators: dedup, filtering, scoring, mixing, formatting and output.

Nothing outside this subpackage imports it.
"""
