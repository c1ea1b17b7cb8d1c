"""Scalar functions and parsers."""
