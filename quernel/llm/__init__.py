"""Operators on training text and code. Nothing outside this subpackage imports it."""
