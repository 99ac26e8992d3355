"""Spark jobs that map near-surface ice slabs from airborne radar."""
