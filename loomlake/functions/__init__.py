"""Column expressions on scalars and vectors (array<double>), all evaluated by Spark."""
