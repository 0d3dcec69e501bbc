"""Column-level functions: missing values, calendar, text and tail probabilities."""
