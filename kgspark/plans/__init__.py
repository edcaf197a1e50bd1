"""Operators on the triple table."""
