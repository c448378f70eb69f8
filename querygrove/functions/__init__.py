"""Scalar functions and small distributions."""
