"""Registered queries with their SQL oracles, and whole monitoring runs."""
