"""Stability analytics for ranked candidate lists, native to Spark."""
