"""Operators for preparing training text, each in its own module; ``queries`` registers them."""
