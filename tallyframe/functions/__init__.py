"""Scalar and array helpers."""
