"""Structured Streaming jobs; each gives the rows of its batch operator."""
