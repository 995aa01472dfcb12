"""Operators for preparing language-model training data (self-contained)."""
