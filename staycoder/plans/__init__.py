"""Whole runs: predict, rewrite a dataset, prepare training data, evaluate."""
