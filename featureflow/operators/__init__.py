"""Distributed operators: profiling, derivation, encoding, splits, evaluation, models."""
