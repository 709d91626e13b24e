"""Operators for training-data pipelines over text tables. Nothing else in the package imports this folder."""
