"""Structured Streaming jobs over change streams."""
