"""Column-level helpers: predicates, bins, rounding, ladders and fixed constants."""
