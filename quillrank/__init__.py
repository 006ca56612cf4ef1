"""Relational and ranking-evaluation operators on Spark DataFrames."""
