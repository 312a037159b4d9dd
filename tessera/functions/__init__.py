"""Column builders: seeded draws, identifier families, text functions."""
