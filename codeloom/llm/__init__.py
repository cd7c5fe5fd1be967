"""Operators for training text and code. Nothing else in the library imports this subpackage."""
