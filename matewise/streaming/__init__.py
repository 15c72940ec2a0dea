"""streaming of the read-pair engine."""
