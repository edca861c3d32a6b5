"""Similarity analytics over sequences, declared on Spark DataFrames."""
