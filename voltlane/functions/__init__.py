"""Column expressions: no actions, no shuffles, no Python in the row path."""
