"""Typed questions asked of long documents, planned by Spark."""
