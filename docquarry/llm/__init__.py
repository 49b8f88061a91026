"""Operators for preparing training data: mixing, scoring, scanning, near-duplicates, formats."""
