"""Composed plans: the cascade and its reports."""
