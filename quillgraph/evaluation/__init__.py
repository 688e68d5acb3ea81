"""Scoring and comparison of answer sets."""
