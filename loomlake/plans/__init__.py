"""Registered graph queries and their SQL."""
