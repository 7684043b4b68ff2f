"""Trace and span analytics as plain PySpark DataFrame operators."""
