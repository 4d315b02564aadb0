"""Operators on text, pages and vectors for preparing large training corpora."""
