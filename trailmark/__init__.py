"""Journey analytics on Spark: canonical events, traces, variants, drift, coverage and more."""
