"""Column -> Column building blocks; nothing here runs a job."""
