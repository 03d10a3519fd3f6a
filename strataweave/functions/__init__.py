"""Column expressions: missing values, text, units, geometry; and coordinate transforms."""
