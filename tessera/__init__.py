"""Tessera: web-page design analytics on Spark DataFrames."""
