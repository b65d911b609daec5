"""Retrieval corpus building and answer-quality analytics on Spark DataFrames."""
