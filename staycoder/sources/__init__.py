"""Reading and writing note tables."""
