"""Operators for building training data, each by one named method.

Nothing outside this package imports it.
"""
