"""Column expressions and type rules."""
