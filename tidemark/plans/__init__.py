"""Shuffle strategies shared by the operators: time/value blocks, salted lookups, value tables."""
