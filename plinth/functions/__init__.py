"""Scalar functions: patterns for paths, package names, text metrics, sequence similarity."""
