"""Diagnostic-knowledge analytics as lazy Spark plans."""
