"""Operators for large text corpora (tokens, filtering, near-dedup, mixing,
vector search). Nothing else in the library imports this subpackage."""
