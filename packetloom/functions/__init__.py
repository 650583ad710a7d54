"""Column expressions and distributed helpers shared by the operators."""
