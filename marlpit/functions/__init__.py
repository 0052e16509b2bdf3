"""Scalar expressions and types."""
