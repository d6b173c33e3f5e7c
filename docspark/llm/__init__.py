"""Operators for large training-data pipelines.  Nothing else in docspark imports this subpackage."""
