"""Composed jobs, the derived input views and the registered queries with their SQL."""
