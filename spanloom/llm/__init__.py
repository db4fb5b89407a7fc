"""Operators for preparing large text collections for model training.

Nothing outside this package imports it; it may use the rest of the library.
"""
