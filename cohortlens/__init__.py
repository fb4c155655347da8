"""Cohort risk analytics as lazy Spark DataFrame operators."""
