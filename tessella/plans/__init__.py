"""Adapters for the driver tables, and the queries over them."""
