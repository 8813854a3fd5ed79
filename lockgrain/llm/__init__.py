"""Operators for preparing training data from inventory records and texts."""
