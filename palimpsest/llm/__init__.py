"""Operators that prepare free text as training data. Nothing outside this package imports it."""
