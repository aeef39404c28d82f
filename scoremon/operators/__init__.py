"""Monitoring operators."""
