"""functions of the read-pair engine."""
