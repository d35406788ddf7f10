"""Curve ordering in phase space on Spark."""
