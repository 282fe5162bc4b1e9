"""Column builders: units, air physics, soil curves, keys, labels, null handling."""
