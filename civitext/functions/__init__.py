"""Column expressions: text, token-id arrays, score arrays."""
