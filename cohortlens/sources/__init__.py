"""Sources of the cohort analytics engine."""
