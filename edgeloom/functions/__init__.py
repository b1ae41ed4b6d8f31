"""Hash-based randomness and comparison statistics."""
