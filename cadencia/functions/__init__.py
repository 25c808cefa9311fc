"""Column builders: pure expressions that stay inside code generation."""
