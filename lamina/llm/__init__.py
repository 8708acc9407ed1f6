"""Operators for preparing training text, one module each; ``queries`` applies them to the tables."""
