"""Shared plan helpers: staging tables and table access."""
