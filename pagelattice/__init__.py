"""Captured-web-page analytics as PySpark DataFrame jobs."""
