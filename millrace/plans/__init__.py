"""Plans over many operators: reading and profiling, folds, training loops, reports."""
