"""Queries over the driver's tables, each beside an independent SQL statement of the same result."""
