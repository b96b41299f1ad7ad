"""Relational operators on matrices: projections, selections, joins, aggregations."""
