"""DataFrame operators: resolution joins, merges, windows, graph analytics."""
