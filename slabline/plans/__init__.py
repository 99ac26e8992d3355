"""Whole jobs, stand-in views and the registered queries."""
