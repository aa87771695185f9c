"""Query catalogue: every registered query with its SQL counterpart."""
