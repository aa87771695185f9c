"""Structured Streaming jobs over the manifest change feed."""
