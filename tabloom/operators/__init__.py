"""DataFrame -> DataFrame operators, grouped by family."""
