"""sources of the read-pair engine."""
