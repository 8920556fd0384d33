"""Operators for training-data pipelines over a table of documents. Nothing outside this folder imports it."""
