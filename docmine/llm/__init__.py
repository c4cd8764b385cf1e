"""Operators for building training corpora: sharding, joins, extraction, packing."""
