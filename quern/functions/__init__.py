"""Scalar functions as Column expressions, and pandas UDFs where built-ins can't express them."""
