"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage; it needs only Spark and
the Python packages that its modules name.
"""
