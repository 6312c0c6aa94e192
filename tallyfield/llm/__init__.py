"""Operators for the text and record problems of training-data pipelines."""
