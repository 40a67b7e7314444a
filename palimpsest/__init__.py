"""Project memory and event graphs on Spark: ranked retrieval, as-of state, hyperbolic neighbours, scheduling, causal matching."""
