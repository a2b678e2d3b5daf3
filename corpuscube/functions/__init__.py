"""Scalar functions: column expressions, and plain Python functions for what no expression covers."""
