"""Operators on DataFrames: filters, joins, aggregates, in-group order, sets and vectors."""
