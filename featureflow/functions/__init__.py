"""Column expressions: derivation rules, keyed splits and normal scores."""
