"""Column-level helpers: vector expressions, keyword predicates, draws, p-values."""
