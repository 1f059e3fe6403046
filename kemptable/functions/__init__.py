"""Column expressions: value text, parsing, names."""
