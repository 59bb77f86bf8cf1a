"""Operators for language-model training data, and their queries."""
