"""Queries over the driver tables and their independent SQL statements."""
