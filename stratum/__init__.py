"""Stratum: a layered warehouse engine on Spark DataFrames."""
