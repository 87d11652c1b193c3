"""Governed corpus analytics on Spark."""
