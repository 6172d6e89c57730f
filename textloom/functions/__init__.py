"""Column functions: analysis, norms, scalar helpers, regular languages."""
