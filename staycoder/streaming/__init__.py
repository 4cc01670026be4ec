"""The batch steps applied to files as they arrive."""
