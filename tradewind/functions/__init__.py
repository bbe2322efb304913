"""Column expressions and generic DataFrame helpers shared by the operators."""
