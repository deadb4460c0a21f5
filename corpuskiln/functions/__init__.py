"""Column expressions: text, chat formats, ordered classification."""
