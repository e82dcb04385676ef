"""Retrieval, annotation analytics and task-state queries on PySpark DataFrames."""
