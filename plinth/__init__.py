"""A PySpark-native engine for structural and flow analysis of fact tables."""
