"""Column builders: every function takes and returns ``Column`` objects."""
