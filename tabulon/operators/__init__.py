"""DataFrame-level operators: aggregates, lookups, reshaping, lambda forms."""
