"""Scalar and array helpers as column functions."""
