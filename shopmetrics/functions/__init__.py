"""Scalar column expressions (built-in Catalyst expressions only)."""
