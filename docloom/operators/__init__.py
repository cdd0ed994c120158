"""Operators, grouped by the data they work on."""
