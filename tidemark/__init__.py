"""tidemark: time-aligned wide tables and column formulas on Spark."""
