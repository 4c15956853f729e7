"""Column-level functions (text cleaning, similarity)."""
