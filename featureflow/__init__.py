"""Profiling, feature derivation and binary classification on Spark DataFrames."""

from .config import Config

__all__ = ["Config"]
