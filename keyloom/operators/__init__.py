"""Operators on keyed relations: partition maps and layouts, joins reduced to digests, statistics."""
