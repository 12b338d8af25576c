"""Column expressions and per-symbol helpers."""
