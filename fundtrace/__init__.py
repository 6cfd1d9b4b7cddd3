"""Suspicious-flow analytics over bank transfers, as Spark DataFrames."""
