"""Column functions: text fields, JSON values, page markup, URLs."""
