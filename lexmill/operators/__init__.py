"""Relational operators: detection, routing, quality flags, registry work, decoding."""
