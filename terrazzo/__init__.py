"""Terrazzo: graph-partition ensembles as Spark DataFrames."""
