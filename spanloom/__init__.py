"""Explainable lexical analysis of versioned text collections on Spark DataFrames."""
