"""operators of the signal analytics engine."""
