"""Column expressions: normalising raw codes, deriving categories, formatting text."""
