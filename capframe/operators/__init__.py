"""Operators over DataFrames: ranking, lookups, vocabulary, metrics, losses."""
