"""Queries over the tables of a data directory, with their equivalent SQL where there is one."""
