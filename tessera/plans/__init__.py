"""Descriptions of queries as plain data."""
