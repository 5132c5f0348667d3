"""Composite jobs and the registry of runnable queries."""
