"""Operators of the cohort analytics engine."""
