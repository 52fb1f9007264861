"""Operators on training text: container packing, evaluation leaks, reading levels."""
