"""Operators for preparing training text at scale. Nothing outside this package imports it."""
