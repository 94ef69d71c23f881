"""Operators for large collections of training records; nothing else in the package imports this."""
