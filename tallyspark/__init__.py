"""Disclosure and text analytics on Spark."""
