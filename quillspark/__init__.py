"""Quillspark: code-structure analytics on PySpark DataFrames."""
