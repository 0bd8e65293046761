"""Column builders shared by the operators."""
