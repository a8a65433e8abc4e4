"""Breakwater: structural-variant analytics and corpus preparation as Spark DataFrames."""
