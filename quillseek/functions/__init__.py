"""Scalar functions and the approximate-matching kernel."""
