"""Registered queries over the given tables, with SQL oracles."""
