"""Structured Streaming forms of the operators that can run as text and facts arrive."""
