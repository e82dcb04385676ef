"""Registered queries over the driver's tables, each with SQL where SQL expresses it."""
