"""Operators of a training-data pipeline: mixing, search, formatting, filters, joins and tokenising."""
