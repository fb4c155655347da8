"""Streaming of the cohort analytics engine."""
