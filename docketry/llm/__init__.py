"""Operators for building training corpora: mixing, tokens, dedup, licences, models, archives, vectors."""
