"""Operators for preparing training data at large scale.  Nothing outside this package imports it."""
