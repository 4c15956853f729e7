"""Incremental (Structured Streaming) runs of the cascade."""
