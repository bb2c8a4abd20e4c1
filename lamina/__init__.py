"""Lamina: a versioned, ordered key-value analytics engine on Spark DataFrames."""
