"""Operators for preparing training data from code and text; nothing outside this package imports it."""
