"""Column expressions; no Python runs on the executors but for Unicode folding."""
