"""Workforce analytics as plain PySpark DataFrame functions."""
