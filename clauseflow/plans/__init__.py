"""Registered queries: each module applies operators to the given tables."""
