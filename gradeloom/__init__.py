"""Spark jobs that grade free-text clinical reports."""
