"""Operators for training-data pipelines: archives, licences, tokens, languages, quality, duplicates, packing."""
