"""operators of the read-pair engine."""
