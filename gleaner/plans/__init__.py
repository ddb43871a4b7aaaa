"""Registered queries: how the operators run over the given tables."""
