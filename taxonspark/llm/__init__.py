"""Operators of a training-data pipeline (see ``registry`` for their queries and SQL)."""
