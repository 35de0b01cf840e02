"""Retrieval and corpus analytics on PySpark DataFrames."""
