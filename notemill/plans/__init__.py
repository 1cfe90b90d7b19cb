"""Queries over the driver's tables, each next to its SQL check."""
