"""Scalar bounds and functions as column expressions."""
