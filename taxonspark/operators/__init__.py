"""DataFrame operators: rule theta-join, nearest-brand top-1, description, keywords."""
