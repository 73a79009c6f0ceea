"""Provenance and training-corpus analytics on Spark DataFrames."""
