"""Decision tables as columns: one row per (entity, as-of) in, states and reason
codes out. Thresholds are parameters or rows of a reference table."""
