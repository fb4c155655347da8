"""Functions of the cohort analytics engine."""
