"""plans of the read-pair engine."""
