"""Extractive-summarization analytics on Spark DataFrames."""
