"""Relational engine for graph-driven, stateful workflows on Spark DataFrames."""
