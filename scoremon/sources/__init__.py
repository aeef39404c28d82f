"""Readers, writers and the derived views used by the registered queries."""
