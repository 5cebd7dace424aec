"""Corpus building, auditing and ranking evaluation on PySpark DataFrames."""
