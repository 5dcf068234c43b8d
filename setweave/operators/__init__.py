"""Operators over collections of sets."""
