"""Operators on DataFrames: cleaning, quality, aggregation, profiling, keyed writes as transforms."""
