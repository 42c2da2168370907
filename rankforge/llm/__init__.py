"""Operators for preparing training text: sharding, joins, filters, formatting, packing, encoding."""
