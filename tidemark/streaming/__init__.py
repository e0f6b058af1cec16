"""Refreshing tables from files that keep arriving."""
