"""Column expressions: text, numbers, arrays and box geometry."""
