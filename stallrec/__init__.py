"""Marketplace recommendations as Spark jobs."""
