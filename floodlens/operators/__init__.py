"""DataFrame operators: each takes frames and returns a lazy frame."""
