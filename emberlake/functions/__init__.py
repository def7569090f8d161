"""Column expressions: severity, geometry, projection, parsing."""
