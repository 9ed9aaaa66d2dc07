"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage; each module is imported by
name where it is needed, so that deleting the folder leaves the rest whole.
"""
