"""Gleaner: a data-cleaning engine on Spark DataFrames."""
